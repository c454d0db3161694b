"""Deterministic baselines: persistence, seasonal naive, climatology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.aggregates import quantile
from gridloom.operators import samples as made
from gridloom.sources.tables import Timeline


def at_hour(history: DataFrame, value: str, name: str) -> DataFrame:
    return history.select(F.col("station").alias("_s"), F.col("hour_idx").alias("_h"), F.col(value).alias(name))


def persistence(samples: DataFrame, filled: DataFrame) -> DataFrame:
    """Adds b0, the filled value at the origin, and b0_source."""
    side = filled.select(F.col("station").alias("_s"), F.col("hour_idx").alias("_h"), F.col("filled").alias("b0"), F.col("source").alias("b0_source"))
    return samples.join(side, (F.col("station") == F.col("_s")) & (F.col("origin_idx") == F.col("_h")), "left").drop("_s", "_h")


def seasonal(samples: DataFrame, panel: DataFrame, period: int = 24) -> DataFrame:
    """Adds b1: the observed value one period before the target if it isn't after the origin, else b0; and b1_direct."""
    side = at_hour(panel.filter(F.col("value").isNotNull()), "value", "_seasonal")
    rows = samples.withColumn("_back", F.col("target_idx") - period)
    rows = rows.join(side, (F.col("station") == F.col("_s")) & (F.col("_back") == F.col("_h")) & (F.col("_back") <= F.col("origin_idx")), "left")
    return rows.withColumn("b1", F.coalesce("_seasonal", "b0")).withColumn("b1_direct", F.col("_seasonal").isNotNull()).drop("_s", "_h", "_back", "_seasonal")


def climatology(train: DataFrame) -> DataFrame:
    """Medians and counts by station, month and hour, by station and hour, and by station. train: station, month, hour, value."""
    sets = [["station", "month", "hour"], ["station", "hour"], ["station"]]
    rows = train.groupingSets([[F.col(k) for k in s] for s in sets], "station", "month", "hour").agg(F.count("value").alias("n"), quantile(F.col("value"), 0.5).alias("median"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 0, "station_month_hour").when(F.col("_g") == 2, "station_hour").otherwise("station")
    return rows.withColumn("level", level).drop("_g")


def climatological(samples: DataFrame, table: DataFrame) -> DataFrame:
    """Adds b2, the finest median that exists for the target's station, month and hour, and b2_level 0, 1 or 2."""
    rows, found = samples, []
    for k, (level, keys) in enumerate((("station_month_hour", ("station", "month", "hour")), ("station_hour", ("station", "hour")), ("station", ("station",)))):
        side = table.filter((F.col("level") == level) & (F.col("n") > 0)).select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("median").alias(f"_median{k}"))
        match = F.lit(True)
        for c in keys:
            match = match & (F.col(c) == F.col(f"_{c}"))
        rows = rows.join(side, match, "left").drop(*[f"_{c}" for c in keys])
        found.append(F.col(f"_median{k}"))
    level = F.when(found[0].isNotNull(), 0).when(found[1].isNotNull(), 1).when(found[2].isNotNull(), 2)
    return rows.withColumn("b2", F.coalesce(*found)).withColumn("b2_level", level).drop("_median0", "_median1", "_median2")


def of_observations(seen: DataFrame, timeline: Timeline, clock: list[Column], horizons: tuple[int, ...] = made.HORIZONS, reach: int = 6, period: int = 24) -> DataFrame:
    """Eligible samples with actual, b0, b1 and b2, as `persistence`, `seasonal` and `climatological` give over the filled panel.

    seen: station, hour_idx, value; clock: month and hour of `hour_idx`. Observations alone tell all of it: a target is one
    of them, what the panel carries to an origin is the latest at most `reach` hours before, and a target's climatology is
    that of its own month and hour. So observations are exchanged once, by station, no hour without one is made, and
    nothing is joined.
    """
    value, train = F.col("value"), F.when(F.col("hour_idx") <= timeline.train_end, F.col("value"))
    series, order = Window.partitionBy("station"), Window.partitionBy("station").orderBy("hour_idx")
    rows = seen.filter(F.col("station").isNotNull() & value.isNotNull()).select("station", "hour_idx", value, F.lit(True).alias("observed"), *clock, quantile(train, 0.5).over(series).alias("_whole"),
        F.last("value").over(order.rangeBetween(-period, -period)).alias("_seasonal"), *[F.last("value").over(order.rangeBetween(-h - reach, -h)).alias(f"_held{h}") for h in horizons])
    medians = [quantile(train, 0.5).over(Window.partitionBy("station", *keys)) for keys in (("month", "hour"), ("hour",))]
    rows = rows.withColumn("b2", F.coalesce(*medians, "_whole"))
    held = [F.when(F.col("horizon") == h, F.coalesce(f"_held{h}", "_whole", F.lit(0.0))) for h in horizons]
    chosen = made.eligible(made.candidates(rows, timeline, horizons, keep=("value", "b2", "_whole", "_seasonal", *[f"_held{h}" for h in horizons])))
    chosen = chosen.withColumn("b0", F.coalesce(*held)).withColumn("b1", F.coalesce(F.when(F.col("horizon") <= period, F.col("_seasonal")), "b0"))
    return chosen.select("sample_id", "partition", "station", "horizon", "target_idx", "origin_idx", F.col("value").alias("actual"), "b0", "b1", "b2")


def as_long(rows: DataFrame, models: tuple[str, ...] = ("b0", "b1", "b2")) -> DataFrame:
    """One row per sample and model, with actual, prediction and residual (positive: predicted too low)."""
    keep = [c for c in rows.columns if c not in models]
    long = rows.unpivot(keep, list(models), "model", "prediction")
    return long.filter(F.col("prediction").isNotNull() & F.col("actual").isNotNull()).withColumn("residual", F.col("actual") - F.col("prediction"))
