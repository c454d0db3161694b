"""Queries over stored layers: partitions, buckets, statistics, locks and archives. All users are stations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.digests import digest_sql, table_digest
from gridloom.operators import baselines, panel, samples
from gridloom.plans.base import GRID, TIME, USERS, full_panel, query, rounded, user_clock, users_seen, users_series
from gridloom.plans.panel_queries import STATISTICS
from gridloom.sources import archives, stored
from gridloom.sources.tables import table, write_table
from gridloom.sources.work import shared_folder

COLUMNS = ["station", "hour_idx", "value", "observed", "filled", "source"]


def stored_users(spark, sf):
    """The timeline, the path of the users' panel, stored by partition, and their observed hours."""
    time, seen = users_seen(spark, sf)
    path = shared_folder(spark, "users")
    stored.store_panel(users_series(time, seen).select(*COLUMNS), path, time)
    return time, path, seen


@query(f"WITH {USERS} SELECT station, count(*) AS hours, count(value) AS observed, round(coalesce(sum(value), 0), 4) AS total, count(*) FILTER (WHERE source = 1) AS carried FROM ufilled WHERE partition = 'train' GROUP BY ALL")
def partition_values(spark, sf):
    """Values of the training partition; the others are not opened."""
    _, path, _ = stored_users(spark, sf)
    rows = stored.open_partition(spark, path, "train")
    return rows.groupBy("station").agg(F.count(F.lit(1)).alias("hours"), F.count("value").alias("observed"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"), F.count_if(F.col("source") == 1).alias("carried"))


@query(f"WITH {USERS} SELECT station, count(*) AS hours, count(*) FILTER (WHERE observed) AS observed, min(hour_idx) AS first_hour, max(hour_idx) AS last_hour FROM ufilled WHERE partition = 'test' GROUP BY ALL")
def partition_presence(spark, sf):
    """What the test partition may tell before it is scored: which hours were observed, and no value."""
    _, path, _ = stored_users(spark, sf)
    rows = stored.open_partition(spark, path, "test", "presence")
    return rows.groupBy("station").agg(F.count(F.lit(1)).alias("hours"), F.count_if("observed").alias("observed"), F.min("hour_idx").alias("first_hour"), F.max("hour_idx").alias("last_hour"))


def persistence(time, seen, partition: str) -> DataFrame:
    """sample_id, station, horizon, target_idx, prediction: the value at the origin for the eligible samples of a partition."""
    rows = baselines.of_observations(seen, time, user_clock(time)).filter(F.col("partition") == partition)
    return rows.select("sample_id", "station", "horizon", "target_idx", F.col("b0").alias("prediction"))


@query(f"""WITH {USERS} SELECT s.horizon, count(*) AS n, round(avg(abs(a.value - o.filled)), 6) AS mae FROM usamples s
JOIN ufilled o ON o.station = s.station AND o.hour_idx = s.origin_idx JOIN ufilled a ON a.station = s.station AND a.hour_idx = s.target_idx WHERE s.partition = 'validation' GROUP BY ALL""")
def oracle_scores(spark, sf):
    """Persistence against the actuals of the validation partition, which alone is read."""
    time, path, seen = stored_users(spark, sf)
    scored = stored.actuals(spark, path, "validation", persistence(time, seen, "validation"))
    return rounded(scored.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("actual") - F.col("prediction"))).alias("mae")))


def windowed(series: DataFrame, context: int = samples.CONTEXT) -> DataFrame:
    """station, hour_idx, and sums over the context that ends there, in whole cents; the context must be full. `origin` tells
    whether an observed hour follows after one of the horizons, so that a sample starts there."""
    last = Window.partitionBy("station").orderBy("hour_idx").rowsBetween(-(context - 1), 0)
    cents = F.round(F.col("filled") * 100)
    full = F.count(F.lit(1)).over(last) == context
    made = [F.count_if("observed").over(last).alias("seen"), F.sum(cents).over(last).alias("cents"), F.first("filled").over(last).alias("oldest"), F.max(cents).over(last).alias("most")]
    order = Window.partitionBy("station").orderBy("hour_idx")
    origin = reduce(lambda a, b: a | b, [F.coalesce(F.lead("observed", h).over(order), F.lit(False)) for h in samples.HORIZONS])
    return series.select("station", "hour_idx", origin.alias("origin"), *[F.when(full, c).alias(n) for c, n in zip(made, ("seen", "cents", "oldest", "most"), strict=True)])


def stored_layers(spark, sf, buckets: int = 16):
    """Names of the series and of the sample index of all users, in buckets by station: more than `buckets` for large panels."""
    time, seen = users_seen(spark, sf)
    buckets = max(buckets, panel.tasks_of(seen, time.hours, ("station",)))
    observed = seen.filter(F.col("value").isNotNull()).withColumn("observed", F.lit(True))
    index = samples.eligible(samples.candidates(observed, time)).select("sample_id", "partition", "station", "horizon", "target_idx", "origin_idx", "context_start")
    series = users_series(time, seen, buckets).select(*COLUMNS)
    return stored.store_buckets(series, shared_folder(spark, "series"), buckets, dealt=True), stored.store_buckets(index, shared_folder(spark, "index"), buckets, order="origin_idx")


@query(f"""WITH {USERS}, w AS (SELECT station, hour_idx, count(*) FILTER (WHERE observed) OVER v AS seen, sum(round(filled * 100)) OVER v AS cents, first_value(filled) OVER v AS oldest, max(round(filled * 100)) OVER v AS most
  FROM ufilled WINDOW v AS (PARTITION BY station ORDER BY hour_idx ROWS BETWEEN 47 PRECEDING AND CURRENT ROW))
SELECT sample_id, horizon, seen, cents, round(oldest, 6) AS oldest, most FROM usamples s JOIN w ON w.station = s.station AND w.hour_idx = s.origin_idx""")
def stored_windows(spark, sf):
    """Contexts of all samples, from the stored series and the stored index: windows need no exchange, four columns are read."""
    series, index = stored_layers(spark, sf)
    held = windowed(stored.stored(spark, series, ["station", "hour_idx", "observed", "filled"])).filter("origin").withColumnsRenamed({"station": "_s", "hour_idx": "_h"})
    rows = stored.stored(spark, index, ["sample_id", "station", "horizon", "origin_idx"])
    rows = rows.join(held.hint("merge"), (F.col("station") == F.col("_s")) & (F.col("origin_idx") == F.col("_h")))
    return rounded(rows.select("sample_id", "horizon", "seen", "cents", "oldest", "most"))


@query(f"""WITH {USERS} SELECT partition, horizon, count(*) AS samples, count(DISTINCT station) AS stations, CAST(min(target_idx) AS INTEGER) AS first_target, CAST(max(target_idx) AS INTEGER) AS last_target FROM usamples GROUP BY ALL""")
def stored_index(spark, sf):
    """The sample index read back, with the columns that are asked for."""
    _, index = stored_layers(spark, sf)
    rows = stored.stored(spark, index, ["partition", "horizon", "station", "target_idx"])
    return rows.groupBy("partition", "horizon").agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("station").alias("stations"), F.min("target_idx").alias("first_target"), F.max("target_idx").alias("last_target"))


@query(f"""WITH {GRID}, s AS ({STATISTICS}), filled AS ({"SELECT g.*, coalesce(value, 0.0) AS x FROM grid g"})
SELECT f.station, f.variable, count(*) AS hours, round(avg((x - median) / coalesce(nullif(iqr, 0), nullif(std, 0))), 6) AS mean_scaled FROM filled f JOIN s ON s.variable = f.variable AND s.station IS NULL GROUP BY ALL""")
def stored_scaling(spark, sf):
    """Training statistics are sealed, read back and verified before they scale anything."""
    grid = full_panel(spark, sf)
    path = f"{shared_folder(spark, 'statistics')}/version=1"
    stored.sealed(panel.scaling_statistics(grid, TIME.train_end), path, version="1")
    rows = panel.scaled(grid.withColumn("filled", F.coalesce("value", F.lit(0.0))), stored.unsealed(spark, path))
    return rounded(rows.groupBy("station", "variable").agg(F.count(F.lit(1)).alias("hours"), F.avg("scaled").alias("mean_scaled")))


@query(f"""WITH {USERS}, p AS (SELECT s.sample_id, s.station, s.horizon, s.target_idx, o.filled AS prediction, a.value AS actual FROM usamples s
  JOIN ufilled o ON o.station = s.station AND o.hour_idx = s.origin_idx JOIN ufilled a ON a.station = s.station AND a.hour_idx = s.target_idx WHERE s.partition = 'test')
, d AS ({digest_sql("p", ["horizon", "prediction", "sample_id", "station", "target_idx"], ["prediction"])})
SELECT horizon, n, mae, digest FROM (SELECT horizon, count(*) AS n, round(avg(abs(actual - prediction)), 6) AS mae FROM p GROUP BY ALL), d""")
def locked_scores(spark, sf):
    """Predictions of the test partition are locked, then scored against actuals that are opened after that; the scores are locked too."""
    time, path, seen = stored_users(spark, sf)
    folder = shared_folder(spark, "locks")
    stored.sealed(persistence(time, seen, "test"), f"{folder}/predictions", model="b0")
    scores = stored.score_locked(spark, f"{folder}/predictions", path, "test", ["horizon"])
    stored.lock_results(rounded(scores), f"{folder}/results", f"{folder}/predictions")
    digest = stored.lock_of(spark, f"{folder}/predictions")["digest"]
    return stored.locked_results(spark, f"{folder}/results", f"{folder}/predictions").withColumn("digest", F.lit(digest))


@query(f"WITH {USERS}, k AS (SELECT partition, station, hour_idx, filled, source FROM ufilled) {digest_sql('k', ['station', 'hour_idx', 'filled', 'source'], ['filled'], ['partition'])}")
def partition_digests(spark, sf):
    """A digest of each stored partition, the same in any order of rows."""
    _, path, _ = stored_users(spark, sf)
    return table_digest(spark.read.parquet(path), ["station", "hour_idx", "filled", "source"], ["partition"])


def order_archives(spark, sf) -> DataFrame:
    """An archive for each customer: a note, and an inner archive with a file for each status of their orders."""
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), "o_orderpriority")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda s: s["line"])
    files = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("content"))
    return archives.packed(files.withColumn("member", F.concat(F.lit("orders/"), "o_orderstatus", F.lit(".csv"))), "o_custkey", "member", "content")


ORDER_FILES = """files AS (
  SELECT CAST(o_custkey AS VARCHAR) AS archive, 'orders/' || o_orderstatus || '.csv' AS name,
         string_agg(o_orderkey || ',' || CAST(round(o_totalprice * 100) AS BIGINT) || ',' || o_orderpriority, chr(10) ORDER BY o_orderkey) || chr(10) AS content FROM orders GROUP BY ALL
), members AS (
  SELECT archive, 'data.zip!' || name AS member, CAST(octet_length(encode(content)) AS BIGINT) AS bytes, sha256(content) AS sha256 FROM files
  UNION ALL SELECT DISTINCT archive, 'README.txt', 17, sha256('orders by status' || chr(10)) FROM files
)"""


@query(f"WITH {ORDER_FILES} SELECT archive, member, bytes, sha256, 'file' AS status FROM members")
def archive_members(spark, sf):
    """Every file in archives within archives, with its size and digest."""
    found = archives.archive_members(order_archives(spark, sf))
    return archives.checked_members(found).filter(F.col("status") == "file")


@query(f"""WITH {ORDER_FILES} SELECT archive, count(*) AS members, CAST(sum(bytes) AS BIGINT) AS bytes, sha256(string_agg(member || ':' || sha256, chr(10) ORDER BY member) || chr(10)) AS sha256 FROM members GROUP BY ALL""")
def archive_manifest(spark, sf):
    """One digest of each archive over its files' names and digests."""
    return archives.member_manifest(archives.archive_members(order_archives(spark, sf)))


@query("SELECT o_orderstatus AS status, count(*) AS orders, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS cents FROM orders GROUP BY ALL")
def table_sink(spark, sf):
    """Orders through the Parquet sink, by status, and back."""
    path = shared_folder(spark, "orders")
    write_table(table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice"), path, ["o_orderstatus"])
    rows = spark.read.parquet(path)
    return rows.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("o_orderkey").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
