"""Streaming and model queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import features, models, samples
from gridloom.plans.base import STATIONS, TARGET, TIME, filled_target, predictions, query, rounded, target_panel
from gridloom.sources.work import shared_folder, written
from gridloom.streaming import panel as streaming


@query(f"""SELECT CAST(user_id % {STATIONS} AS INTEGER) AS station, event_type AS variable, CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS INTEGER) AS hour_idx, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_hourly(spark, sf):
    """The whole table in one micro-batch, because its files need not be in the order of time."""
    out = shared_folder(spark, "hourly")
    stream = streaming.hourly(streaming.event_stream(spark, f"{sf}/events.parquet", None), STATIONS)
    streaming.run_available(stream, f"{out}/rows", f"{out}/state")
    rows = streaming.latest(spark, f"{out}/rows", ["station", "variable", "hour"])
    start = F.lit(TIME.start).cast("timestamp")
    hour = ((F.unix_timestamp("hour") - F.unix_timestamp(start)) / 3600).cast("int")
    return rows.select("station", "variable", hour.alias("hour_idx"), "n", F.round("total", 4).alias("total"))


@query(f"""WITH h AS (SELECT CAST(user_id % {STATIONS} AS INTEGER) AS station, CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS INTEGER) AS hour_idx, avg(value) AS value FROM events WHERE event_type = '{TARGET}' GROUP BY ALL)
, g AS (SELECT s.station, CAST(i AS INTEGER) AS hour_idx, h.value FROM (SELECT station, max(hour_idx) AS last FROM h GROUP BY ALL) s JOIN range(720) r(i) ON i <= s.last LEFT JOIN h ON h.station = s.station AND h.hour_idx = i)
, c AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY station ORDER BY hour_idx RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS held FROM g)
SELECT station, hour_idx, round(coalesce(held, -99.0), 6) AS filled, CASE WHEN value IS NOT NULL THEN 0 WHEN held IS NOT NULL THEN 1 ELSE 2 END AS source FROM c""")
def stream_carry(spark, sf):
    out = shared_folder(spark, "carry")
    hours = target_panel(spark, sf).filter("observed").select("station", "hour_idx", "value")
    schema = "station int, hour_idx int, value double"
    for block in range(3):  # blocks arrive in the order of time, each in as many files as it has tasks
        hours.filter(F.floor(F.col("hour_idx") / 240) == block).write.parquet(f"{out}/in/{block}")
        arriving = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/in")
        streaming.run_available(streaming.carry(arriving, 6, -99.0), f"{out}/rows", f"{out}/state", "append")
    return rounded(spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/rows").select("station", "hour_idx", "filled", "source"))


@query()
def gbt_fit(spark, sf):
    """Boosted trees with absolute loss on lags and trailing statistics of the target, fitted by horizon; MAE by horizon and partition."""
    wide = filled_target(spark, sf).select("station", "hour_idx", "filled")
    made = wide.select("station", "hour_idx", *features.lags("filled", (0, 1, 2, 3, 6, 12, 24)), *features.trailing("filled", (6, 24))).na.drop()
    rows = predictions(spark, sf).select("station", "horizon", "target_idx", "partition", "actual", F.col("origin_idx").alias("hour_idx"))
    data = rows.join(made, ["station", "hour_idx"])
    names = [c for c in made.columns if c not in ("station", "hour_idx")]
    scored = []
    for horizon in samples.HORIZONS:
        own = data.filter(F.col("horizon") == horizon)
        scored.append(models.boosted_trees(own.filter(F.col("partition") == "train"), own, names, "actual"))
    found = reduce(DataFrame.unionByName, scored)
    return found.groupBy("horizon", "partition").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("actual") - F.col("prediction"))).alias("mae"))


@query()
def batch_inference(spark, sf):
    """A linear sequence model, fitted to all training contexts by summed products, run over all contexts of 48 hours in Arrow batches."""
    filled = filled_target(spark, sf).select("station", "hour_idx", "filled")
    rows = filled.select("station", "hour_idx", features.context(["filled"], 48).alias("steps"), F.lead("filled").over(features.series()).alias("ahead")).filter(F.col("steps").isNotNull())
    flat = written(rows.select("station", "hour_idx", F.transform("steps", lambda s: s["filled"]).alias("steps"), "ahead"), "contexts")
    weights = models.linear_fit(flat.filter((F.col("hour_idx") < TIME.train_end) & F.col("ahead").isNotNull()), "ahead")
    return rounded(models.infer(flat, models.linear(weights)))
