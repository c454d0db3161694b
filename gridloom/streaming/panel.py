"""Structured Streaming: hourly means behind a watermark, and the causal carry as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = 1) -> DataFrame:
    """A directory or file of Parquet events as a stream; event time becomes a TIMESTAMP, which watermarks need.

    Files that are not in the order of time lose rows to a watermark between micro-batches; with `files_per_batch` None,
    all files that are there make one micro-batch, and none of their rows is late.
    """
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema)
    source = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source
    rows = source.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, it may be one file
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, stations: int, delay: str = "2 hours") -> DataFrame:
    """station, variable, hour, n, total: tumbling hours; events later than the watermark allows are dropped."""
    rows = events.withWatermark("ts", delay)
    keys = [(F.col("user_id") % stations).cast("int").alias("station"), F.col("event_type").alias("variable")]
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("station", "variable", F.col("w.start").alias("hour"), "n", "total")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "update") -> None:
    """Runs a stream over what is there; every micro-batch is written as Parquet with its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:06d}_")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last update of each key of a stream in update mode."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out)
    value = F.struct("batch", *[c for c in rows.columns if c not in (*keys, "batch")])
    return rows.groupBy(*keys).agg(F.max(value).alias("_v")).select(*keys, *[F.col(f"_v.{c}") for c in rows.columns if c not in (*keys, "batch")])


def carry(observations: DataFrame, reach: int, fallback: float) -> DataFrame:
    """station, hour_idx, filled, source for every hour up to the last one seen of each station.

    observations: station, hour_idx, value, in order of time across micro-batches. The state of a station is its last
    hour and value; hours that were skipped are emitted when a later one arrives: carried up to `reach` hours, then the
    fallback. An hour at or before the last one is late and dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, value = state.get if state.exists else (-1, None)
        rows = pd.concat(list(frames)).sort_values("hour_idx")  # one station's part of one micro-batch
        out = []
        for hour, seen in zip(rows["hour_idx"].tolist(), rows["value"].tolist(), strict=True):
            if hour <= at:
                continue
            for gap in range(at + 1, hour):
                near = value is not None and gap - at <= reach
                out.append((key[0], gap, value if near else fallback, 1 if near else 2))
            out.append((key[0], hour, seen, 0))
            at, value = hour, seen
        state.update((at, value))
        yield pd.DataFrame(out, columns=["station", "hour_idx", "filled", "source"])

    return observations.groupBy("station").applyInPandasWithState(step, "station int, hour_idx int, filled double, source int", "at int, value double", "append", GroupStateTimeout.NoTimeout)
