"""Queries over data quality, missingness, distributions and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import audit, compare, stats
from gridloom.operators import places as maps
from gridloom.plans.base import GRID, OBS, STATIONS, TARGET, TIME, corr_sql, full_panel, query, rounded, target_panel
from gridloom.sources.tables import table
from gridloom.sources.work import written

KIND = """CASE WHEN raw IS NULL OR raw = '' OR raw = 'NA' THEN 'missing' WHEN regexp_matches(raw, '^[+-]?[0-9]+$') THEN 'int'
  WHEN TRY_CAST(raw AS DOUBLE) IS NOT NULL AND (isnan(TRY_CAST(raw AS DOUBLE)) OR isinf(TRY_CAST(raw AS DOUBLE))) THEN 'nonfinite' WHEN TRY_CAST(raw AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'text' END"""


@query(f"""WITH long AS (SELECT 'props_amount' AS "column", CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'NA' WHEN event_id % 13 = 0 THEN 'x' || event_id WHEN event_id % 17 = 0 THEN 'NaN' ELSE CAST(value AS VARCHAR) END AS raw FROM events
  UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT 'event_type', event_type FROM events), k AS (SELECT "column", {KIND} AS kind, count(*) AS cells FROM long GROUP BY ALL)
SELECT "column", kind, cells, round(cells / CAST(sum(cells) OVER (PARTITION BY "column") AS DOUBLE), 8) AS rate FROM k""")
def value_kinds(spark, sf):
    """Raw cells with missing, malformed and non-finite ones among them."""
    i = F.col("event_id")
    dirty = F.when(i % 7 == 0, None).when(i % 11 == 0, "NA").when(i % 13 == 0, F.concat(F.lit("x"), i)).when(i % 17 == 0, "NaN").otherwise(F.col("value").cast("string"))
    return audit.value_kinds(table(spark, sf, "events").withColumn("props_amount", dirty), ["props_amount", "user_id", "event_type"])


@query("""WITH long AS (SELECT 'l_quantity' AS "column", l_quantity AS x FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem)
SELECT "column", count(*) FILTER (WHERE x IS NULL) AS missing, count(*) FILTER (WHERE x < 0) AS negative, count(*) FILTER (WHERE x = 0) AS zero, min(x) AS min, max(x) AS max, count(DISTINCT x) AS distinct_values FROM long GROUP BY ALL
UNION ALL SELECT 'c_acctbal', count(*) FILTER (WHERE c_acctbal IS NULL), count(*) FILTER (WHERE c_acctbal < 0), count(*) FILTER (WHERE c_acctbal = 0), min(c_acctbal), max(c_acctbal), count(DISTINCT c_acctbal) FROM customer""")
def column_missing(spark, sf):
    return audit.column_profile(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).union(audit.column_profile(table(spark, sf, "customer"), ["c_acctbal"]))


@query("""WITH g AS (SELECT l_partkey, l_suppkey, l_shipdate, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT count(*) AS keys, count(*) FILTER (WHERE n > 1) AS duplicated_keys, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM g""")
def duplicates(spark, sf):
    return audit.duplicates(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey", "l_shipdate"])


@query("""SELECT l_orderkey, count(l_linenumber) AS n, min(l_linenumber) = 1 AND max(l_linenumber) = count(l_linenumber) AND count(DISTINCT l_linenumber) = count(l_linenumber) AS dense FROM lineitem GROUP BY ALL""")
def dense_numbering(spark, sf):
    return audit.dense_numbering(table(spark, sf, "lineitem"), "l_linenumber", ["l_orderkey"])


@query(f"""WITH {OBS}, o AS (SELECT station, hour_idx FROM obs WHERE variable = '{TARGET}'), e AS (SELECT s AS station, CAST(i AS INTEGER) AS hour_idx FROM (SELECT DISTINCT station AS s FROM o), range(24, 720) h(i))
SELECT station, hour_idx, 'missing' AS gap FROM (SELECT * FROM e EXCEPT SELECT * FROM o) UNION ALL SELECT station, hour_idx, 'unexpected' FROM (SELECT * FROM o EXCEPT SELECT * FROM e)""")
def grid_gaps(spark, sf):
    """The expected grid starts a day late, so some observations are unexpected."""
    grid = target_panel(spark, sf)
    observed = grid.filter("observed").select("station", "hour_idx")
    return audit.grid_gaps(observed, grid.filter(F.col("hour_idx") >= 24).select("station", "hour_idx"), ["station", "hour_idx"])


@query("""SELECT event_type, count(*) AS rows, count(*) FILTER (WHERE json_keys(props) = ['k']) AS matching, count(*) FILTER (WHERE NOT coalesce(json_valid(props), false)) AS broken FROM events GROUP BY ALL""")
def schema_check(spark, sf):
    """Whether the properties of every event have the expected keys; a table's own columns must be those expected as well."""
    events = table(spark, sf, "events")
    if not audit.schema_matches({"events": events}, ["event_id", "ts", "user_id", "event_type", "value", "props"])["events"]:
        raise ValueError("events has other columns than expected")
    return audit.json_matches(events, "props", ["k"], ["event_type"])


RUNS = """, flagged AS (SELECT station, variable, hour_idx, hour_idx - row_number() OVER (PARTITION BY station, variable ORDER BY hour_idx) AS island FROM grid WHERE NOT observed)
, runs AS (SELECT station, variable, min(hour_idx) AS start, max(hour_idx) AS "end", count(*) AS length FROM flagged GROUP BY station, variable, island)"""


def missing_run_rows(spark, sf):
    grid = full_panel(spark, sf)
    return grid, audit.runs(grid, ~F.col("observed"), ("station", "variable"))


@query(f'WITH {GRID}{RUNS} SELECT station, variable, start, "end", length FROM runs')
def missing_runs(spark, sf):
    return missing_run_rows(spark, sf)[1]


@query(f"""WITH {GRID}{RUNS} SELECT s.variable, s.station, count(length) AS n_runs, coalesce(max(length), 0) AS longest, round(coalesce(quantile_cont(length, 0.5), 0.0), 6) AS median, round(coalesce(quantile_cont(length, 0.9), 0.0), 6) AS p90,
  {", ".join(f"count(*) FILTER (WHERE length <= {k}) AS runs_le_{k}h" for k in (1, 3, 6, 12, 24))}, count(*) FILTER (WHERE length > 24) AS runs_gt_24h, CAST(coalesce(sum(length) FILTER (WHERE length > 24), 0) AS BIGINT) AS hours_in_runs_gt_24h
  FROM (SELECT DISTINCT variable, station FROM grid) s LEFT JOIN runs r ON r.variable = s.variable AND r.station = s.station GROUP BY GROUPING SETS ((s.variable), (s.variable, s.station))""")
def run_summary_sets(spark, sf):
    grid, found = missing_run_rows(spark, sf)
    return rounded(audit.run_summary(grid, found, [["variable"], ["variable", "station"]]))


@query(f"""WITH {GRID}{RUNS} SELECT variable, CASE WHEN length <= 1 THEN '1' WHEN length <= 3 THEN '2-3' WHEN length <= 6 THEN '4-6' WHEN length <= 12 THEN '7-12' WHEN length <= 24 THEN '13-24' WHEN length <= 48 THEN '25-48' ELSE '>48' END AS bucket, count(*) AS runs FROM runs GROUP BY ALL""")
def run_length_buckets(spark, sf):
    return audit.run_buckets(missing_run_rows(spark, sf)[1], ["variable"])


@query(f"""WITH {GRID}, h AS (SELECT variable, hour_idx, count(*) FILTER (WHERE NOT observed) AS k FROM grid GROUP BY ALL), c AS (SELECT variable, k, count(*) AS hours FROM h GROUP BY ALL)
SELECT v.variable, CAST(i AS INTEGER) AS k, coalesce(hours, 0) AS hours FROM (SELECT DISTINCT variable FROM grid) v CROSS JOIN range({STATIONS + 1}) r(i) LEFT JOIN c ON c.variable = v.variable AND c.k = i""")
def simultaneous_missing(spark, sf):
    return audit.simultaneous_missing(full_panel(spark, sf), STATIONS)


@query(f"""WITH {GRID}, k AS (SELECT observed, unnest([{{'d': 'station', 'k': CAST(station AS VARCHAR)}}, {{'d': 'variable', 'k': variable}}, {{'d': 'hour', 'k': CAST(hour_idx % 24 AS VARCHAR)}}, {{'d': 'day', 'k': CAST(hour_idx // 24 AS VARCHAR)}}]) AS s FROM grid)
SELECT s.d AS dimension, s.k AS key, count(*) AS hours, count(*) FILTER (WHERE NOT observed) AS missing, round(CAST(count(*) FILTER (WHERE NOT observed) * 100.0 / count(*) AS DOUBLE), 6) AS missing_pct FROM k GROUP BY ALL""")
def temporal_missingness(spark, sf):
    keys = {"station": F.col("station"), "variable": F.col("variable"), "hour": F.col("hour_idx") % 24, "day": F.floor(F.col("hour_idx") / 24)}
    return rounded(audit.missing_by(full_panel(spark, sf), keys))


@query(f"WITH {GRID}, m AS (SELECT variable, station, count(*) FILTER (WHERE NOT observed) * 100.0 / count(*) AS pct FROM grid GROUP BY ALL) SELECT variable, {', '.join(f'round(CAST(max(pct) FILTER (WHERE station = {s}) AS DOUBLE), 6) AS s{s}' for s in range(STATIONS))} FROM m GROUP BY ALL")
def missingness_matrix(spark, sf):
    rows = full_panel(spark, sf).groupBy("variable").pivot("station", list(range(STATIONS))).agg(F.avg((~F.col("observed")).cast("int")) * 100)
    return rounded(rows.select("variable", *[F.col(f"`{s}`").alias(f"s{s}") for s in range(STATIONS)]))


def level_sql(column, levels):
    slots = ", ".join(f"'{x}'" for x in [*levels, "MISSING"])
    return f"""WITH c AS (SELECT coalesce({column}, 'MISSING') AS category, count(*) AS n FROM orders GROUP BY ALL), k AS (SELECT unnest([{slots}]) AS category)
SELECT category, coalesce(n, 0) AS rows, round(coalesce(n, 0) * 100.0 / sum(coalesce(n, 0)) OVER (), 6) AS pct FROM k LEFT JOIN c USING (category)"""


def level_counts(spark, sf, column, levels):
    return rounded(audit.category_counts(table(spark, sf, "orders"), column, levels).withColumn("pct", F.col("pct").cast("double")))


PRIORITIES, STATUSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER"], ["F", "O", "P", "X"]


@query(level_sql("o_orderstatus", STATUSES))
def category_counts(spark, sf):
    """All orders by status; one category has none."""
    return level_counts(spark, sf, "o_orderstatus", STATUSES)


@query(level_sql("o_orderpriority", PRIORITIES))
def category_counts_all(spark, sf):
    """All orders by priority; one category has none."""
    return level_counts(spark, sf, "o_orderpriority", PRIORITIES)


QUANTILES = ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{int(p * 100):02d}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))


@query(f"""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, {QUANTILES},
  round((avg(value * value * value) - 3 * avg(value) * avg(value * value) + 2 * avg(value) * avg(value) * avg(value)) / pow(var_pop(value), 1.5), 6) AS skewness FROM events GROUP BY ALL""")
def describe_stats(spark, sf):
    return rounded(stats.describe(table(spark, sf, "events"), "value", ["event_type"]))


@query(f"WITH {GRID} SELECT station, count(value) AS n, round(quantile_cont(value, 0.95), 6) AS threshold FROM grid WHERE variable = '{TARGET}' AND hour_idx <= 359 GROUP BY GROUPING SETS ((), (station))")
def severe_thresholds(spark, sf):
    return rounded(stats.thresholds(target_panel(spark, sf).filter(F.col("hour_idx") <= TIME.train_end), "value", "station"))


@query("""WITH h AS (SELECT quantile_cont(value, 0.99) AS high FROM events), c AS (SELECT least(CAST(floor(value / high * 60) AS INTEGER), 59) AS bin, count(*) AS n FROM events, h WHERE value >= 0 AND value <= high GROUP BY ALL)
SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS count FROM range(60) r(i) LEFT JOIN c ON c.bin = i""")
def histogram(spark, sf):
    return stats.histogram(table(spark, sf, "events"), "value")


@query(f"""WITH {GRID}, t AS (SELECT * FROM grid WHERE variable = '{TARGET}' AND observed), l AS (SELECT a.station, v.lag, count(*) AS pairs, {corr_sql("a.value", "b.value", 30)} AS r FROM t a CROSS JOIN (VALUES (1), (6), (24)) v(lag)
  JOIN t b ON b.station = a.station AND b.hour_idx = a.hour_idx - v.lag GROUP BY ALL) SELECT station, CAST(lag AS INTEGER) AS lag, pairs, round(r, 6) AS r FROM l""")
def autocorrelation(spark, sf):
    return rounded(stats.autocorrelation(target_panel(spark, sf), "value", (1, 6, 24), ("station",)))


@query(f"""WITH {GRID}, t AS (SELECT * FROM grid WHERE variable = '{TARGET}' AND observed)
SELECT a.station AS a, b.station AS b, count(*) AS pairs, round({corr_sql("a.value", "b.value")}, 6) AS r FROM t a JOIN t b ON a.hour_idx = b.hour_idx GROUP BY a.station, b.station""")
def cross_corr(spark, sf):
    return rounded(stats.station_correlation(target_panel(spark, sf)))


@query(f"""WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)
SELECT l_returnflag, count(*) AS n, round({corr_sql("rx", "ry")}, 6) AS rho FROM r GROUP BY ALL""")
def spearman_pairs(spark, sf):
    return rounded(stats.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]))


@query("SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY ALL")
def ols_fit(spark, sf):
    rows = stats.least_squares(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return rows.select("l_returnflag", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


PLACES = "places AS (SELECT n_nationkey AS place, n_regionkey * 10.0 + n_nationkey AS lat, n_nationkey * 7.0 - 80 AS lon FROM nation)"
KM = f"""{PLACES}, km AS (SELECT a.place AS source, b.place AS target, 2 * {scalars.EARTH_KM} * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km
  FROM places a JOIN places b ON a.place <> b.place)"""


def places(spark, sf):
    key = F.col("n_nationkey")
    return table(spark, sf, "nation").select(key.alias("place"), (F.col("n_regionkey") * 10.0 + key).alias("lat"), (key * 7.0 - 80).alias("lon"))


@query(f"WITH {KM} SELECT source, target, round(km, 6) AS km FROM km")
def haversine_distances(spark, sf):
    return rounded(maps.distances(places(spark, sf)))


@query(f"""WITH {KM}, q AS (SELECT quantile_cont(km, 0.25) AS q0, quantile_cont(km, 0.5) AS q1, quantile_cont(km, 0.75) AS q2 FROM km)
SELECT CASE WHEN km <= q0 THEN 0 WHEN km <= q1 THEN 1 WHEN km <= q2 THEN 2 ELSE 3 END AS bin, count(*) AS n, round(avg(km), 4) AS mean_x, round(avg(source + target), 4) AS mean_y FROM km, q GROUP BY ALL""")
def distance_quartiles(spark, sf):
    rows = stats.quartile_bins(maps.distances(places(spark, sf)).withColumn("y", F.col("source") + F.col("target")), "km", "y")
    return rows.select("bin", "n", F.round("mean_x", 4).alias("mean_x"), F.round("mean_y", 4).alias("mean_y"))


CUSTOMERS = "(SELECT c_custkey AS place, (c_custkey * 37 % 1801) / 10.0 - 90 AS lat, (c_custkey * 101 % 3607) / 10.0 - 180 AS lon FROM customer)"


@query(f"""WITH p AS {CUSTOMERS}, km AS (SELECT a.place, b.place AS neighbour, 2 * {scalars.EARTH_KM} * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km
  FROM p a JOIN p b ON a.place <> b.place) SELECT place, CAST(row_number() OVER (PARTITION BY place ORDER BY km, neighbour) AS INTEGER) AS rank, neighbour, round(km, 6) AS km FROM km QUALIFY rank <= 3""")
def nearest_places(spark, sf):
    """The three nearest other customers of each, on a map that their keys make: cells and rings, no table of all pairs."""
    key = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(key.alias("place"), ((key * 37 % 1801) / 10.0 - 90).alias("lat"), ((key * 101 % 3607) / 10.0 - 180).alias("lon"))
    return rounded(maps.nearest(rows, 3))


def weights(spark, sf):
    """Trade between nations of customers and suppliers, as weights of a graph."""
    o, l, c, s = (table(spark, sf, t) for t in ("orders", "lineitem", "customer", "supplier"))
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


WEIGHTS = """weights AS (SELECT s_nationkey AS source, c_nationkey AS target, CAST(count(*) AS DOUBLE) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


@query(f"""WITH {KM}, {WEIGHTS} SELECT source, target, round(km, 6) AS km, weight, row_number() OVER (PARTITION BY target ORDER BY km, source) = 1 AS nearest,
  CAST(row_number() OVER (PARTITION BY target ORDER BY weight DESC, source) AS INTEGER) AS weight_rank, row_number() OVER (PARTITION BY target ORDER BY weight DESC, source) = 1 AS heaviest FROM km JOIN weights USING (source, target)""")
def nearest_neighbour(spark, sf):
    return rounded(compare.edges(maps.edge_distances(weights(spark, sf), places(spark, sf))))


@query(f"WITH {WEIGHTS} SELECT round(sum(weight) FILTER (WHERE source = target) / sum(weight), 6) AS self_share, round(sum(weight) FILTER (WHERE source <> target) / sum(weight), 6) AS cross_share FROM weights")
def attention_shares(spark, sf):
    return rounded(compare.self_share(weights(spark, sf)))


@query(f"""WITH {GRID} SELECT variable, CAST(hour_idx % 24 AS INTEGER) AS hour, round(coalesce(quantile_cont(value, 0.5), 0.0), 6) AS median, round(coalesce(avg(value), 0.0), 8) AS mean FROM grid WHERE hour_idx <= 359 GROUP BY ALL""")
def hourly_profile(spark, sf):
    keys = ["variable", "hour"]
    rows = written(full_panel(spark, sf).filter(F.col("hour_idx") <= TIME.train_end).select("variable", (F.col("hour_idx") % 24).alias("hour"), "value"), "hours-values")
    medians = stats.quantiles(rows, "value", keys, {"median": 0.5})
    means = rows.groupBy(*keys).agg(F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 8).alias("mean"))
    return means.join(medians, keys, "left").select(*keys, F.round(F.coalesce("median", F.lit(0.0)), 6).alias("median"), "mean")


@query("SELECT o_orderkey, 'train|' || (o_custkey % 12) || '|' || strftime(o_orderdate, '%Y%m%d%H') || '|h6' AS sample_id, date_trunc('hour', o_orderdate) = o_orderdate AS whole_hour, CAST(6 AS INTEGER) AS horizon FROM orders")
def sample_ids(spark, sf):
    made = table(spark, sf, "orders").withColumn("sample_id", scalars.sample_id(F.lit("train"), F.col("o_custkey") % 12, F.col("o_orderdate"), F.lit(6)))
    parts = scalars.parse_sample_id(F.col("sample_id"))
    return made.select("o_orderkey", "sample_id", (parts["target"] == F.col("o_orderdate")).alias("whole_hour"), parts["horizon"].alias("horizon"))


@query("""WITH grid AS (
  SELECT row_number() OVER (ORDER BY s, p) - 1 AS candidate, status, priority
  FROM (SELECT * FROM (VALUES (1, 'O'), (2, 'F'), (3, 'P')) a(s, status) CROSS JOIN (VALUES (1, '1-URGENT'), (2, '3-MEDIUM'), (3, '5-LOW')) b(p, priority))
), scores AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, avg(round(o_totalprice * 100)) AS mae, max(round(o_totalprice * 100)) AS rmse FROM orders GROUP BY ALL)
SELECT candidate, status, priority, n, round(mae, 6) AS mae, rmse, row_number() OVER (ORDER BY mae, rmse, candidate) = 1 AS best, row_number() OVER (ORDER BY mae DESC, rmse DESC, candidate) = 1 AS worst FROM grid JOIN scores USING (status, priority)""")
def best_and_worst_candidates(spark, sf):
    """A grid of statuses and priorities in the order of nesting, scored by the orders that it meets, in whole cents."""
    grid = compare.candidates(spark, {"status": ["O", "F", "P"], "priority": ["1-URGENT", "3-MEDIUM", "5-LOW"]})
    cents = F.round(F.col("o_totalprice") * 100)
    scores = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.avg(cents).alias("mae"), F.max(cents).alias("rmse"))
    rows = grid.join(scores, ["status", "priority"]).withColumn("all", F.lit(1))
    best = compare.selected(rows, ["all"], [F.col("candidate")]).select("candidate", F.lit(True).alias("best"))
    worst = compare.selected(rows.select("all", "candidate", *[(-F.col(c)).alias(c) for c in ("mae", "rmse")]), ["all"], [F.col("candidate")]).select("candidate", F.lit(True).alias("worst"))
    told = rows.join(best, "candidate", "left").join(worst, "candidate", "left")
    return rounded(told.select("candidate", "status", "priority", "n", "mae", "rmse", F.coalesce("best", F.lit(False)).alias("best"), F.coalesce("worst", F.lit(False)).alias("worst")))
