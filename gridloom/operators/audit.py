"""Data-quality audit and missingness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.aggregates import quantile
from gridloom.functions.scalars import rate, value_kind

RUN_BUCKETS = ((1, "1"), (3, "2-3"), (6, "4-6"), (12, "7-12"), (24, "13-24"), (48, "25-48"))


def as_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, raw: one row per cell."""
    return rows.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "raw")


def value_kinds(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Cells by column and kind of value, with their share."""
    kinds = as_text(rows, columns).groupBy("column", value_kind(F.col("raw")).alias("kind")).agg(F.count(F.lit(1)).alias("cells"))
    return kinds.withColumn("rate", rate(F.col("cells"), F.sum("cells").over(Window.partitionBy("column"))))


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """missing, negative, zero, min, max and distinct values by numeric column."""
    long = as_text(rows, columns).withColumn("x", F.col("raw").try_cast("double"))
    x = F.col("x")
    return long.groupBy("column").agg(F.count_if(x.isNull()).alias("missing"), F.count_if(x < 0).alias("negative"), F.count_if(x == 0).alias("zero"), F.min(x).alias("min"), F.max(x).alias("max"), F.countDistinct("raw").alias("distinct_values"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and rows beyond the first of each."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n") > 1).alias("duplicated_keys"), F.sum(F.col("n") - 1).alias("extra_rows"))


def dense_numbering(rows: DataFrame, number: str, keys: list[str]) -> DataFrame:
    """Whether numbers run from 1 to n without gaps or repeats in each group."""
    n = F.col(number)
    return rows.groupBy(*keys).agg(F.count(n).alias("n"), ((F.min(n) == 1) & (F.max(n) == F.count(n)) & (F.countDistinct(n) == F.count(n))).alias("dense"))


def grid_gaps(observed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that are missing, and observed ones that weren't expected."""
    missing = expected.join(observed, keys, "left_anti").select(*keys, F.lit("missing").alias("gap"))
    return missing.union(observed.join(expected, keys, "left_anti").select(*keys, F.lit("unexpected").alias("gap")))


def schema_matches(frames: dict[str, DataFrame], expected: list[str]) -> dict[str, bool]:
    """Whether each table has exactly the expected columns in their order."""
    return {name: df.columns == expected for name, df in frames.items()}


def json_matches(rows: DataFrame, column: str, expected: list[str], by: list[str]) -> DataFrame:
    """by, rows, matching, broken: texts that are objects with exactly the expected keys in their order, and texts that are none."""
    keys = F.json_object_keys(F.col(column))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(keys == F.array(*map(F.lit, expected))).alias("matching"), F.count_if(keys.isNull()).alias("broken"))


def runs(panel: DataFrame, flag: Column, keys: tuple[str, ...]) -> DataFrame:
    """Maximal stretches of hours where the flag holds: keys, start, end, length."""
    flagged = panel.filter(flag)
    island = F.col("hour_idx") - F.row_number().over(Window.partitionBy(*keys).orderBy("hour_idx"))
    return flagged.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("hour_idx").alias("start"), F.max("hour_idx").alias("end"), F.count(F.lit(1)).alias("length")).drop("_island")


def run_summary(series: DataFrame, found: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Runs over grouping sets of a series table; groups without runs count 0."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    n = F.col("length")
    least = lambda k: F.count_if(n <= k).alias(f"runs_le_{k}h")
    rows = series.select(*keys).distinct().join(found, keys, "left")
    return rows.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(
        F.count(n).alias("n_runs"), F.coalesce(F.max(n), F.lit(0)).alias("longest"), F.coalesce(quantile(n, 0.5), F.lit(0.0)).alias("median"), F.coalesce(quantile(n, 0.9), F.lit(0.0)).alias("p90"),
        *[least(k) for k in (1, 3, 6, 12, 24)], F.count_if(n > 24).alias("runs_gt_24h"), F.coalesce(F.sum(F.when(n > 24, n)), F.lit(0)).alias("hours_in_runs_gt_24h"),
    )


def run_buckets(found: DataFrame, keys: list[str]) -> DataFrame:
    label = reduce(lambda acc, b: acc.when(F.col("length") <= b[0], b[1]), RUN_BUCKETS[1:], F.when(F.col("length") <= RUN_BUCKETS[0][0], RUN_BUCKETS[0][1])).otherwise(">48")
    return found.groupBy(*keys, label.alias("bucket")).agg(F.count(F.lit(1)).alias("runs"))


def simultaneous_missing(panel: DataFrame, stations: int) -> DataFrame:
    """Hours by how many stations miss a variable at once; counts of 0 stay."""
    hours = panel.groupBy("variable", "hour_idx").agg(F.count_if(~F.col("observed")).cast("int").alias("k")).groupBy("variable", "k").agg(F.count(F.lit(1)).alias("hours"))
    slots = panel.select("variable").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(stations))))
    return slots.join(hours, ["variable", "k"], "left").fillna(0, ["hours"])


def missing_by(panel: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """hours, missing and percent missing by each of several keys: dimension, key."""
    named = panel.select("observed", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("key")) for d, c in keys.items()])).alias("k"))
    return named.groupBy("k.dimension", "k.key").agg(F.count(F.lit(1)).alias("hours"), F.count_if(~F.col("observed")).alias("missing"), (F.count_if(~F.col("observed")) * 100.0 / F.count(F.lit(1))).cast("double").alias("missing_pct"))


def category_counts(rows: DataFrame, column: str, categories: list[str], missing: str = "MISSING") -> DataFrame:
    """Rows of each category, with those that have none and those without a category."""
    spark = rows.sparkSession
    slots = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in [*categories, missing]])).alias("category"))
    counted = rows.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias("category")).agg(F.count(F.lit(1)).alias("rows"))
    joined = slots.join(counted, "category", "left").fillna(0, ["rows"])
    return joined.withColumn("pct", F.col("rows") * 100.0 / F.sum("rows").over(Window.partitionBy()))
