"""Stored layers of a panel: partitions behind views, series and indexes in buckets, statistics and locks with digests.

* A panel is stored by partition. `open_partition` reads one of them, so the others are pruned before any file is opened,
  and refuses, while the plan is built, values of a partition that only its presence may be known of.
* Series and sample indexes are stored in buckets by station, in order of hours. Windows by station read a bucket as it
  lies, without an exchange.
* Statistics, predictions and results are written once, beside a digest that every later read adds up again; a changed
  table is an error.

Tables may be empty; null stations and values are rows like any other. A second write to the same path is an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.digests import table_digest
from gridloom.sources.tables import Timeline, write_table

PARTITIONS, MODES = ("train", "validation", "test"), ("values", "presence")


class Refused(ValueError):
    """A read that the stage of a study doesn't allow."""


def store_panel(panel: DataFrame, path: str, timeline: Timeline) -> None:
    """Writes a panel with `hour_idx` by partition, once."""
    write_table(panel.withColumn("partition", timeline.partition(F.col("hour_idx"))), path, ["partition"])


def open_partition(spark: SparkSession, path: str, partition: str, mode: str = "values", readable: tuple[str, ...] = ("train",), values: tuple[str, ...] = ("value", "filled", "source")) -> DataFrame:
    """One partition of a stored panel. Mode `values` has all columns, for readable partitions only; mode `presence` has
    none of the value columns."""
    if mode not in MODES or partition not in PARTITIONS:
        raise Refused(f"no partition {partition!r} or no mode {mode!r}")
    if mode == "values" and partition not in readable:
        raise Refused(f"values of partition {partition!r} are sealed; readable are {', '.join(readable)}")
    rows = spark.read.parquet(path).filter(F.col("partition") == partition)
    return rows.drop(*values) if mode == "presence" else rows


def actuals(spark: SparkSession, path: str, partition: str, predictions: DataFrame) -> DataFrame:
    """`predictions` (station, target_idx, ...) with `actual` from one stored partition, opened for scoring.

    The query fails where a target lies outside of the partition. Null predictions are refused as well. Files of a stored
    panel are far smaller than its rows, so they are not broadcast by their size.
    """
    if partition not in PARTITIONS:
        raise Refused(f"no partition {partition!r}")
    truth = spark.read.parquet(path).filter(F.col("partition") == partition).select(F.col("station").alias("_s"), F.col("hour_idx").alias("_h"), F.col("value").alias("actual"))
    rows = predictions.join(truth.hint("merge"), F.col("station").eqNullSafe(F.col("_s")) & (F.col("target_idx") == F.col("_h")), "left")
    fits = F.assert_true(F.col("_h").isNotNull(), F.lit(f"a target outside of the partition {partition}")).isNull()
    made = F.assert_true(F.col("prediction").isNotNull(), F.lit("a target without a prediction")).isNull()
    return rows.filter(fits & made).drop("_s", "_h")


def store_buckets(df: DataFrame, path: str, buckets: int, key: str = "station", order: str = "hour_idx", dealt: bool = False) -> str:
    """Writes a table in buckets by key, one file a bucket, sorted by key and order; returns its name in the catalog.
    `dealt` says that rows lie in as many partitions by key already."""
    name = f"gridloom_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(buckets, key)).write.mode("errorifexists").bucketBy(buckets, key).sortBy(key, order).option("path", path).format("parquet").saveAsTable(name)
    return name


def stored(spark: SparkSession, name: str, columns: list[str]) -> DataFrame:
    """Some columns of a table in buckets; the others are not read."""
    return spark.table(name).select(*columns)


def sealed(df: DataFrame, path: str, **facts: str) -> None:
    """Writes a table once, and beside it a lock with its rows, its digest and further facts."""
    write_table(df, f"{path}/rows")
    kept = df.sparkSession.read.parquet(f"{path}/rows")
    lock = table_digest(kept, sorted(kept.columns)).withColumns({k: F.lit(v) for k, v in facts.items()})
    write_table(lock.coalesce(1), f"{path}/lock", fmt="json")  # one row


def lock_of(spark: SparkSession, path: str) -> dict:
    return spark.read.json(f"{path}/lock").first().asDict()


def unsealed(spark: SparkSession, path: str) -> DataFrame:
    """A table that `sealed` wrote, after its rows and digest were added up again; an error if they differ from the lock."""
    rows, lock = spark.read.parquet(f"{path}/rows"), lock_of(spark, path)
    found = table_digest(rows, sorted(rows.columns)).first()
    if (found["rows"], found["digest"]) != (lock["rows"], lock["digest"]):
        raise Refused(f"the table at {path} is not the one that was locked: {found['rows']} rows for {lock['rows']}")
    return rows


def score_locked(spark: SparkSession, predictions: str, panel: str, partition: str, keys: list[str]) -> DataFrame:
    """keys, n, mae of locked predictions in one partition: actuals are opened only after the lock has been verified."""
    rows = actuals(spark, panel, partition, unsealed(spark, predictions)).filter(F.col("actual").isNotNull())
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("actual") - F.col("prediction"))).alias("mae"))


def lock_results(scores: DataFrame, path: str, predictions: str) -> None:
    """Seals a table of scores together with the digest of the predictions that were scored."""
    sealed(scores, path, prediction_digest=lock_of(scores.sparkSession, predictions)["digest"])


def locked_results(spark: SparkSession, path: str, predictions: str) -> DataFrame:
    """Sealed scores, if they and the predictions behind them are still the ones that were locked."""
    unsealed(spark, predictions)
    if lock_of(spark, path)["prediction_digest"] != lock_of(spark, predictions)["digest"]:
        raise Refused("the scores belong to other predictions")
    return unsealed(spark, path)
