"""Severe events: stretches of hours above a threshold, and how models did in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Hours of a block in which events meet errors.
BLOCK = 48


def severe_events(panel: DataFrame, threshold: float, keys: tuple[str, ...] = ("station",)) -> DataFrame:
    """keys, event, start, end, duration, mean, peak, peak_hour (the first of equal peaks). A missing hour ends an event."""
    over = panel.filter(F.col("value") > threshold)
    island = F.col("hour_idx") - F.row_number().over(Window.partitionBy(*keys).orderBy("hour_idx"))
    rows = over.withColumn("_island", island).groupBy(*keys, "_island").agg(
        F.min("hour_idx").alias("start"), F.max("hour_idx").alias("end"), F.count(F.lit(1)).alias("duration"), F.avg("value").alias("mean"),
        F.max("value").alias("peak"), F.max_by("hour_idx", F.struct("value", -F.col("hour_idx"))).alias("peak_hour"),
    )
    return rows.withColumn("event", F.row_number().over(Window.partitionBy(*keys).orderBy("start"))).drop("_island")


def event_metrics(events: DataFrame, errors: DataFrame, threshold: float) -> DataFrame:
    """Errors of each model and horizon within each event.

    Both meet by station and block of `BLOCK` hours: an event is in each block that it touches, an error in one, so a
    pair meets once, and errors are not held against the events of other times. Files of stored errors are far smaller
    than their rows, so no side is broadcast by its size.
    """
    blocks = F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor(F.col("end") / BLOCK)))
    e = events.select(F.col("station").alias("_s"), "event", "start", "end", "peak_hour", blocks.alias("_block"))
    rows = errors.join(e.hint("merge"), (F.col("station") == F.col("_s")) & (F.floor(F.col("target_idx") / BLOCK) == F.col("_block")) & F.col("target_idx").between(F.col("start"), F.col("end"))).drop("_s", "_block")
    at_peak, at_start = F.col("target_idx") == F.col("peak_hour"), F.col("target_idx") == F.col("start")
    return rows.groupBy("station", "event", "model", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("residual")).alias("mae"), F.avg("residual").alias("mean_residual"),
        F.max(F.when(at_peak, F.col("prediction"))).alias("prediction_at_peak"), F.max(F.when(at_peak, F.col("residual"))).alias("residual_at_peak"),
        F.coalesce(F.bool_or(at_start & (F.col("prediction") > threshold)), F.lit(False)).alias("flagged_at_start"), F.count_if(F.col("prediction") > threshold).alias("predicted_severe_hours"),
    )


def event_statistics(events: DataFrame) -> DataFrame:
    return events.groupBy("station").agg(F.count(F.lit(1)).alias("events"), F.avg("duration").alias("mean_duration"), F.max("duration").alias("longest"), F.max("peak").alias("highest_peak"), F.min_by("start", F.struct(-F.col("peak"), "start")).alias("highest_start"))
