"""Checks between stages: digests, drift, reconciliation, shortlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def artifact_digests(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """name, rows, digest of each artifact: an order-free sum of row hashes, so large artifacts cost no task more."""
    row = F.xxhash64(*columns).cast("decimal(38,0)")
    return rows.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("rows"), F.sum(row).cast("string").alias("digest"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, status: same, changed, added or removed, by digest."""
    b, a = before.select("name", F.col("digest").alias("_before")), after.select("name", F.col("digest").alias("_after"))
    status = F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").when(F.col("_before") == F.col("_after"), "same").otherwise("changed")
    return b.join(a, "name", "full_outer").select("name", status.alias("status"))


def reconciled(rows: DataFrame, found: Column, locked: Column, tolerance: float = 1e-9) -> DataFrame:
    """`rows`, or a failing query where a value is further from its locked value than the tolerance."""
    near = F.abs(found - locked) < tolerance
    return rows.filter(F.assert_true(F.coalesce(near, F.lit(False)), "a value differs from the locked one").isNull())


def extremes(scores: DataFrame, metric: str, keys: list[str], member: str) -> DataFrame:
    """The members with the least and the highest metric; ties go to the smaller member."""
    return scores.groupBy(*keys).agg(F.min_by(member, F.struct(metric, member)).alias("easiest"), F.min(metric).alias("least"), F.min_by(member, F.struct(-F.col(metric), member)).alias("hardest"), F.max(metric).alias("highest"))


def penalties(full: DataFrame, held_out: DataFrame, metric: str, keys: list[str]) -> DataFrame:
    """What leaving a member out costs: mean absolute penalty and the mean of relative ones in percent."""
    rows = full.select(*keys, F.col(metric).alias("_f")).join(held_out.select(*keys, F.col(metric).alias("_h")), keys)
    d = F.col("_h") - F.col("_f")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("penalty"), F.avg(F.try_divide(d * 100, F.nullif(F.col("_f"), F.lit(0.0)))).alias("penalty_pct"), F.count_if(d > 0).alias("worse"))


def shortlist(parts: list[DataFrame], metric: str) -> DataFrame:
    """Rows of several result tables with their origin, by mean metric."""
    whole = parts[0].withColumn("origin", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        whole = whole.unionByName(part.withColumn("origin", F.lit(i)))
    return whole.groupBy("model", "origin").agg(F.avg(metric).alias("mean"), F.count(F.lit(1)).alias("runs"))


def training_summary(losses: DataFrame, keys: list[str], step: str, loss: str) -> DataFrame:
    """First and last loss of each run."""
    return losses.groupBy(*keys).agg(F.count(F.lit(1)).alias("steps"), F.min_by(loss, step).alias("first"), F.max_by(loss, step).alias("last"))
