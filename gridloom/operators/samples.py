"""Samples: candidates by horizon, eligibility, guards against leakage, as-of lookups, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import hour_timestamp, sample_id, window_bounds
from gridloom.sources.tables import Timeline

HORIZONS, CONTEXT = (1, 6, 12, 24), 48


def candidates(target: DataFrame, timeline: Timeline, horizons: tuple[int, ...] = HORIZONS, context: int = CONTEXT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every hour of a target series for every horizon, with origin, context, partition, reason and id, and kept columns.

    reason: insufficient_history is tested first, then target_missing; else eligible.
    """
    rows = target.select("station", F.col("hour_idx").alias("target_idx"), "observed", *keep).withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    first, origin = window_bounds(F.col("target_idx"), F.col("horizon"), context)
    reason = F.when(first < 0, "insufficient_history").when(~F.col("observed"), "target_missing").otherwise("eligible")
    rows = rows.select("station", "horizon", "target_idx", origin.alias("origin_idx"), first.alias("context_start"), reason.alias("reason"), timeline.partition(F.col("target_idx")).alias("partition"), *keep)
    return rows.withColumn("sample_id", sample_id(F.col("partition"), F.col("station"), hour_timestamp("target_idx", timeline.start), F.col("horizon")))


def eligible(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reason") == "eligible").drop("reason")


def sample_counts(rows: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Candidates, exclusions by reason and eligible samples over grouping sets."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    counts = [F.count(F.lit(1)).alias("candidates"), *[F.count_if(F.col("reason") == r).alias(r) for r in ("insufficient_history", "target_missing", "eligible")]]
    return rows.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(*counts)


def boundary_samples(rows: DataFrame, keys: tuple[str, ...] = ("partition", "station", "horizon")) -> DataFrame:
    """First, middle (index n // 2) and last sample of each cell, by target."""
    window = Window.partitionBy(*keys)
    at = F.row_number().over(window.orderBy("target_idx")) - 1
    n = F.count(F.lit(1)).over(window)
    place = F.when(at == 0, "first").when(at == n - 1, "last").when(at == F.floor(n / 2), "middle")
    return rows.withColumn("place", place).filter(F.col("place").isNotNull())


def violations(rows: DataFrame, used: Column, ceiling: Column) -> DataFrame:
    """How often a lookup uses an hour after its origin, or after what is revealed; both must be 0."""
    return rows.agg(F.count(F.lit(1)).alias("lookups"), F.count_if(used > F.col("origin_idx")).alias("after_origin"), F.count_if(used > ceiling).alias("after_ceiling"))


def window_invariants(rows: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Counts of samples whose context breaks a rule: ends at the origin, starts context - 1 before, precedes the target."""
    return rows.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("origin_idx") - F.col("context_start") + 1 != context).alias("bad_length"),
        F.count_if(F.col("target_idx") - F.col("horizon") != F.col("origin_idx")).alias("bad_origin"),
        F.count_if(F.col("origin_idx") >= F.col("target_idx")).alias("not_before_target"),
        F.count_if(F.col("context_start") < 0).alias("before_start"),
    )


def asof_latest(panel: DataFrame, max_age: int, keys: tuple[str, ...] = ("station",)) -> DataFrame:
    """Adds the latest observation at most `max_age` hours old and its age; null where there is none."""
    window = Window.partitionBy(*keys).orderBy("hour_idx").rangeBetween(-max_age, 0)
    found = F.last(F.when(F.col("value").isNotNull(), F.struct("value", F.col("hour_idx").alias("at"))), ignorenulls=True).over(window)
    return panel.withColumn("_found", found).withColumn("asof_value", F.col("_found.value")).withColumn("asof_age", F.col("hour_idx") - F.col("_found.at")).drop("_found")


def guarded_lookup(rows: DataFrame, history: DataFrame, at: Column, ceiling: int) -> DataFrame:
    """Adds `looked_up`: the history's value at an hour that is neither after the origin nor after the ceiling."""
    open_ = history.filter(F.col("hour_idx") <= ceiling).select(F.col("station").alias("_s"), F.col("hour_idx").alias("_h"), F.col("value").alias("looked_up"))
    asked = rows.withColumn("_at", at).withColumn("refused", (F.col("_at") > F.col("origin_idx")) | (F.col("_at") > ceiling))
    return asked.join(open_, (F.col("station") == F.col("_s")) & (F.col("_at") == F.col("_h")) & ~F.col("refused"), "left").drop("_s", "_h", "_at")


def grouped(rows: DataFrame, stations: list) -> DataFrame:
    """One row per target hour and horizon, a column per station with its target; null where a station has no sample."""
    return rows.groupBy("target_idx", "horizon").pivot("station", stations).agg(F.max("actual"))


def scattered(groups: DataFrame, stations: list, name: str = "prediction") -> DataFrame:
    """Groups back to rows; empty slots go."""
    long = groups.unpivot(["target_idx", "horizon"], [F.col(f"`{s}`") for s in stations], "station", name)
    return long.filter(F.col(name).isNotNull()).withColumn("station", F.col("station").cast("int"))


def reveal_blocks(rows: DataFrame, block_hours: int) -> DataFrame:
    """Chronological blocks of origins with their ceiling, the largest origin of a block."""
    return rows.groupBy(F.floor(F.col("origin_idx") / block_hours).cast("int").alias("block")).agg(F.count(F.lit(1)).alias("samples"), F.min("origin_idx").alias("first_origin"), F.max("origin_idx").alias("ceiling"))


def withheld(rows: DataFrame, station) -> DataFrame:
    """Leave one station out: its actuals become null."""
    return rows.withColumn("actual", F.when(F.col("station") != station, F.col("actual")))


def scored_once(predictions: DataFrame, samples: DataFrame) -> DataFrame:
    """Joins predictions to samples after checking that each sample has one finite prediction and nothing else has."""
    joined = samples.select("sample_id").join(predictions, "sample_id", "full_outer")
    counts = joined.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("sample_id").alias("ids"), F.count_if(F.col("prediction").isNull() | F.isnan("prediction")).alias("bad")).first()
    if counts["rows"] != counts["ids"] or counts["bad"] or counts["rows"] != samples.count():
        raise ValueError(f"predictions don't match the samples: {counts}")
    return samples.join(predictions, "sample_id")
