"""Queries over panels, samples, guards, baselines and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.functions.digests import digest_sql, steps_sql, table_digest
from gridloom.operators import features, panel, places, samples
from gridloom.plans.base import (
    FILLED, GRID, PREDICTED, SAMPLES, STATIONS, TARGET, TIME, VARIABLES, candidates, climatology_table, filled_panel, filled_target, full_panel, predictions, query, rounded, target_panel,
)
from gridloom.sources.tables import table
from gridloom.sources.work import written


@query(f"WITH {GRID} SELECT station, variable, hour_idx, round(value, 6) AS value, observed FROM grid")
def grid_panel(spark, sf):
    return rounded(full_panel(spark, sf).select("station", "variable", "hour_idx", "value", "observed"))


@query(f"WITH {FILLED} SELECT station, variable, hour_idx, round(filled, 6) AS filled, source FROM filled")
def causal_fill(spark, sf):
    return rounded(filled_panel(spark, sf).select("station", "variable", "hour_idx", "filled", "source"))


@query(f"WITH {FILLED} SELECT station, variable, hour_idx, CAST(gap_age AS INTEGER) AS gap_age FROM filled")
def gap_age(spark, sf):
    return panel.gap_age(full_panel(spark, sf)).select("station", "variable", "hour_idx", "gap_age")


@query(f"""WITH {GRID}, coded AS (
  SELECT station, hour_idx, CASE WHEN value IS NOT NULL THEN CAST(floor(value) AS INTEGER) % 16 END AS code FROM grid WHERE variable = '{TARGET}'
), held AS (
  SELECT *, last_value(code IGNORE NULLS) OVER (PARTITION BY station ORDER BY hour_idx RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS h FROM coded
) SELECT station, hour_idx, coalesce(h, 16) AS filled_code, CASE WHEN code IS NOT NULL THEN 0 WHEN h IS NOT NULL THEN 1 ELSE 2 END AS source FROM held""")
def categorical_fill(spark, sf):
    coded = target_panel(spark, sf).withColumn("code", (F.floor("value").cast("int") % 16))
    return panel.categorical_fill(coded, "code").select("station", "hour_idx", "filled_code", "source")


@query(f"""WITH {FILLED} SELECT CASE WHEN hour_idx <= 359 THEN 'train' WHEN hour_idx <= 539 THEN 'validation' ELSE 'test' END AS partition, station, variable,
  count(*) FILTER (WHERE source = 0) AS raw_observed, count(*) FILTER (WHERE source = 1) AS causal_ffill, count(*) FILTER (WHERE source = 2) AS median_fallback,
  CAST(max(gap_age) AS INTEGER) AS max_gap_age FROM filled GROUP BY ALL""")
def fill_source_audit(spark, sf):
    return panel.fill_audit(panel.gap_age(filled_panel(spark, sf)), TIME.partition(F.col("hour_idx")))


STATISTICS = """SELECT variable, station, count(*) AS n, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75,
  quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, avg(value) AS mean, stddev_pop(value) AS std
  FROM grid WHERE hour_idx <= 359 AND value IS NOT NULL GROUP BY GROUPING SETS ((variable), (variable, station))"""


@query(f"WITH {GRID}, s AS ({STATISTICS}) SELECT variable, station, n, round(median, 6) AS median, round(p25, 6) AS p25, round(p75, 6) AS p75, round(iqr, 6) AS iqr, round(mean, 6) AS mean, round(std, 6) AS std FROM s")
def scaling_stats_sets(spark, sf):
    return rounded(panel.scaling_statistics(full_panel(spark, sf), TIME.train_end))


@query(f"""WITH {FILLED}, s AS ({STATISTICS}) SELECT f.station, f.variable, hour_idx, round((filled - median) / coalesce(nullif(iqr, 0), nullif(std, 0)), 6) AS scaled,
  CASE WHEN iqr <> 0 THEN 'median_iqr' WHEN std <> 0 THEN 'median_std_zero_iqr_fallback' ELSE 'constant' END AS method
  FROM filled f JOIN s ON s.variable = f.variable AND s.station IS NULL""")
def robust_scale(spark, sf):
    statistics = panel.scaling_statistics(full_panel(spark, sf), TIME.train_end)
    return rounded(panel.scaled(filled_panel(spark, sf), statistics).select("station", "variable", "hour_idx", "scaled", "method"))


@query("""WITH t AS (SELECT o_orderkey, o_orderdate AS ts FROM orders) SELECT o_orderkey,
  round(sin(hour(ts) * (2 * pi()) / 24), 6) + 0.0 AS hour_sin, round(cos(hour(ts) * (2 * pi()) / 24), 6) + 0.0 AS hour_cos,
  round(sin((dayofyear(ts) - 1) * (2 * pi()) / dayofyear(make_date(year(ts), 12, 31))), 6) + 0.0 AS doy_sin, round(cos((dayofyear(ts) - 1) * (2 * pi()) / dayofyear(make_date(year(ts), 12, 31))), 6) + 0.0 AS doy_cos,
  round(sin((month(ts) - 1) * (2 * pi()) / 12), 6) + 0.0 AS month_sin, round(cos((month(ts) - 1) * (2 * pi()) / 12), 6) + 0.0 AS month_cos,
  CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofyear(ts) AS INTEGER) AS doy, CAST(month(ts) AS INTEGER) AS month FROM t""")
def calendar_cyclic(spark, sf):
    rows = rounded(table(spark, sf, "orders").select("o_orderkey", *scalars.calendar(F.col("o_orderdate"))))
    return rows.select(*[(F.col(c) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in rows.dtypes])  # no negative zeros


@query(f"""WITH {SAMPLES} SELECT partition || '|' || station || '|' || strftime(TIMESTAMP '2024-01-01' + to_hours(target_idx), '%Y%m%d%H') || '|h' || horizon AS sample_id,
  station, CAST(horizon AS INTEGER) AS horizon, target_idx, CAST(origin_idx AS INTEGER) AS origin_idx, CAST(context_start AS INTEGER) AS context_start, partition FROM candidates WHERE reason = 'eligible'""")
def sample_universe(spark, sf):
    return samples.eligible(candidates(spark, sf)).select("sample_id", "station", "horizon", "target_idx", "origin_idx", "context_start", "partition")


@query(f"""WITH {SAMPLES} SELECT partition, station, CAST(horizon AS INTEGER) AS horizon, count(*) AS candidates, count(*) FILTER (WHERE reason = 'insufficient_history') AS insufficient_history,
  count(*) FILTER (WHERE reason = 'target_missing') AS target_missing, count(*) FILTER (WHERE reason = 'eligible') AS eligible
  FROM candidates GROUP BY GROUPING SETS ((partition, station, horizon), (partition), (station), (horizon), (station, horizon))""")
def sample_counts_sets(spark, sf):
    sets = [["partition", "station", "horizon"], ["partition"], ["station"], ["horizon"], ["station", "horizon"]]
    return samples.sample_counts(candidates(spark, sf), sets)


@query(f"WITH {SAMPLES} SELECT partition, CAST(horizon AS INTEGER) AS horizon, reason, count(*) AS samples FROM candidates GROUP BY ALL")
def eligibility_reasons(spark, sf):
    return candidates(spark, sf).groupBy("partition", "horizon", "reason").agg(F.count(F.lit(1)).alias("samples"))


@query(f"""WITH {SAMPLES}, cells AS (
  SELECT partition, station, horizon, target_idx, row_number() OVER (PARTITION BY partition, station, horizon ORDER BY target_idx) - 1 AS pos,
         count(*) OVER (PARTITION BY partition, station, horizon) AS n FROM candidates WHERE reason = 'eligible'
), placed AS (SELECT *, CASE WHEN pos = 0 THEN 'first' WHEN pos = n - 1 THEN 'last' WHEN pos = n // 2 THEN 'middle' END AS place FROM cells)
SELECT partition, station, CAST(horizon AS INTEGER) AS horizon, target_idx, place FROM placed WHERE place IS NOT NULL""")
def boundary_samples(spark, sf):
    return samples.boundary_samples(samples.eligible(candidates(spark, sf))).select("partition", "station", "horizon", "target_idx", "place")


@query(f"""WITH {SAMPLES} SELECT count(*) AS lookups, count(*) FILTER (WHERE target_idx - 24 > origin_idx) AS after_origin,
  count(*) FILTER (WHERE target_idx - 24 > 539) AS after_ceiling FROM candidates WHERE reason = 'eligible'""")
def leakage_violations(spark, sf):
    return samples.violations(samples.eligible(candidates(spark, sf)), F.col("target_idx") - 24, F.lit(TIME.validation_end))


@query(f"""WITH {SAMPLES} SELECT count(*) AS samples, count(*) FILTER (WHERE origin_idx - context_start + 1 <> 48) AS bad_length, count(*) FILTER (WHERE target_idx - horizon <> origin_idx) AS bad_origin,
  count(*) FILTER (WHERE origin_idx >= target_idx) AS not_before_target, count(*) FILTER (WHERE context_start < 0) AS before_start FROM candidates WHERE reason = 'eligible'""")
def window_invariants(spark, sf):
    return samples.window_invariants(samples.eligible(candidates(spark, sf)))


@query(f"""WITH {GRID}, t AS (SELECT * FROM grid WHERE variable = '{TARGET}')
SELECT g.station, g.hour_idx, round(o.value, 6) AS asof_value, g.hour_idx - o.hour_idx AS asof_age
FROM t g ASOF LEFT JOIN (SELECT * FROM t WHERE observed) o ON g.station = o.station AND g.hour_idx >= o.hour_idx WHERE o.hour_idx IS NULL OR g.hour_idx - o.hour_idx <= 3
UNION ALL SELECT g.station, g.hour_idx, NULL, NULL FROM t g ASOF JOIN (SELECT * FROM t WHERE observed) o ON g.station = o.station AND g.hour_idx >= o.hour_idx WHERE g.hour_idx - o.hour_idx > 3""")
def asof_latest_within(spark, sf):
    return rounded(samples.asof_latest(target_panel(spark, sf), 3).select("station", "hour_idx", "asof_value", "asof_age"))


@query(f"""WITH {SAMPLES}, asked AS (SELECT *, target_idx - 12 AS at_idx FROM candidates WHERE reason = 'eligible')
SELECT a.station, CAST(a.horizon AS INTEGER) AS horizon, a.target_idx, (at_idx > origin_idx) OR (at_idx > 539) AS refused, round(t.value, 6) AS looked_up
FROM asked a LEFT JOIN target t ON t.station = a.station AND t.hour_idx = at_idx AND at_idx <= origin_idx AND at_idx <= 539""")
def guarded_lookup(spark, sf):
    rows = samples.eligible(candidates(spark, sf))
    return rounded(samples.guarded_lookup(rows, target_panel(spark, sf), F.col("target_idx") - 12, TIME.validation_end).select("station", "horizon", "target_idx", "refused", "looked_up"))


@query(f"WITH {PREDICTED} SELECT station, CAST(horizon AS INTEGER) AS horizon, target_idx, round(actual, 6) AS actual, round(b0, 6) AS b0, b0_source FROM predicted")
def b0_persistence(spark, sf):
    return rounded(predictions(spark, sf).select("station", "horizon", "target_idx", "actual", "b0", "b0_source"))


@query(f"WITH {PREDICTED} SELECT station, CAST(horizon AS INTEGER) AS horizon, target_idx, round(b1, 6) AS b1, b1_direct FROM predicted")
def b1_seasonal(spark, sf):
    return rounded(predictions(spark, sf).select("station", "horizon", "target_idx", "b1", "b1_direct"))


@query(f"WITH {PREDICTED} SELECT station, CAST(horizon AS INTEGER) AS horizon, target_idx, round(b2, 6) AS b2, b2_level FROM predicted")
def b2_climatology(spark, sf):
    return rounded(predictions(spark, sf).select("station", "horizon", "target_idx", "b2", "b2_level"))


@query(f"""WITH {PREDICTED} SELECT station, CAST(month AS INTEGER) AS month, CAST(hour AS INTEGER) AS hour, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median,
  CASE WHEN grouping(month) = 0 THEN 'station_month_hour' WHEN grouping(hour) = 0 THEN 'station_hour' ELSE 'station' END AS level
  FROM clim GROUP BY GROUPING SETS ((station, month, hour), (station, hour), (station))""")
def climatology_sets(spark, sf):
    return rounded(climatology_table(filled_target(spark, sf)))


@query(f"""WITH {PREDICTED} SELECT station, CAST(horizon AS INTEGER) AS horizon, count(*) AS n, count(*) FILTER (WHERE b0_source = 0) AS b0_observed, count(*) FILTER (WHERE b0_source = 1) AS b0_carried,
  count(*) FILTER (WHERE b0_source = 2) AS b0_fallback, count(*) FILTER (WHERE b1_direct) AS b1_direct, count(*) FILTER (WHERE b1 = b0) AS b1_equals_b0, count(*) FILTER (WHERE b2_level = 0) AS b2_finest
  FROM predicted GROUP BY GROUPING SETS ((station), (horizon))""")
def baseline_diagnostics(spark, sf):
    rows = predictions(spark, sf)
    return rows.groupingSets([[F.col("station")], [F.col("horizon")]], "station", "horizon").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("b0_source") == k).alias(f"b0_{n}") for k, n in enumerate(("observed", "carried", "fallback"))],
        F.count_if("b1_direct").alias("b1_direct"), F.count_if(F.col("b1") == F.col("b0")).alias("b1_equals_b0"), F.count_if(F.col("b2_level") == 0).alias("b2_finest"),
    )


LAG_SQL = ", ".join(["round(value, 6) AS value_lag0", *[f"round(lag(value, {k}) OVER w, 6) AS value_lag{k}" for k in features.LAGS if k]])


@query(f"WITH {GRID} SELECT station, hour_idx, {LAG_SQL} FROM grid WHERE variable = '{TARGET}' WINDOW w AS (PARTITION BY station ORDER BY hour_idx)")
def lag_features(spark, sf):
    return rounded(target_panel(spark, sf).select("station", "hour_idx", *features.lags("value")))


TRAIL_SQL = ", ".join(f"round(CASE WHEN count(filled) OVER w{n} = {n} THEN {f}(filled) OVER w{n} END, {3 if s == 'std' else 6}) AS filled_{s}{n}" for n in features.SPANS for s, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))
TRAIL_WINDOWS = ", ".join(f"w{n} AS (PARTITION BY station ORDER BY hour_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in features.SPANS)


@query(f"WITH {FILLED}, cents AS (SELECT station, hour_idx, round(filled * 100) AS filled FROM filled WHERE variable = '{TARGET}') SELECT station, hour_idx, {TRAIL_SQL} FROM cents WINDOW {TRAIL_WINDOWS}")
def trailing_stats(spark, sf):
    """Over whole cents, whose sums are exact in any order."""
    cents = filled_target(spark, sf).withColumn("filled", F.round(F.col("filled") * 100))
    rows = cents.select("station", "hour_idx", *features.trailing("filled"))
    return rows.select("station", "hour_idx", *[F.round(c, 3 if "_std" in c else 6).alias(c) for c in rows.columns[2:]])


MASK_SQL = ", ".join(f"round(CASE WHEN count(*) OVER m{n} = {n} THEN avg(CAST(observed AS INTEGER)) OVER m{n} END, 6) AS observed_share{n}" for n in features.MASK_SPANS)
MASK_WINDOWS = ", ".join(f"m{n} AS (PARTITION BY station ORDER BY hour_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in features.MASK_SPANS)


@query(f"WITH {GRID} SELECT station, hour_idx, {MASK_SQL} FROM grid WHERE variable = '{TARGET}' WINDOW {MASK_WINDOWS}")
def mask_fractions(spark, sf):
    return rounded(target_panel(spark, sf).select("station", "hour_idx", *features.mask_fractions("observed")))


@query(f"""WITH {GRID}, c AS (SELECT station, hour_idx, count(*) OVER w AS n, list(coalesce(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), 'null')) OVER w AS steps
  FROM grid WHERE variable = '{TARGET}' WINDOW w AS (PARTITION BY station ORDER BY hour_idx ROWS BETWEEN 47 PRECEDING AND CURRENT ROW))
SELECT station, hour_idx, array_to_string(steps, ',') AS steps FROM c WHERE n = 48""")
def context_window(spark, sf):
    rows = target_panel(spark, sf).select("station", "hour_idx", F.round(F.col("value") * 100).cast("long").cast("string").alias("v"))
    rows = rows.select("station", "hour_idx", features.context(["v"]).alias("steps")).filter(F.col("steps").isNotNull())
    return rows.select("station", "hour_idx", F.array_join(F.transform("steps", lambda s: F.coalesce(s["v"], F.lit("null"))), ",").alias("steps"))


@query(f"""WITH {GRID}, c AS (SELECT station, hour_idx, count(*) OVER w AS n, count(value) OVER w AS seen FROM grid WHERE variable = '{TARGET}'
  WINDOW w AS (PARTITION BY station ORDER BY hour_idx ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)), f AS (SELECT * FROM c WHERE n = 48)
SELECT a.station, a.hour_idx, count(*) AS neighbours, CAST(sum(b.seen) AS BIGINT) AS observed_steps FROM f a JOIN f b ON a.hour_idx = b.hour_idx AND a.station <> b.station GROUP BY ALL""")
def neighbour_window(spark, sf):
    rows = features.neighbour_context(target_panel(spark, sf).filter(F.col("hour_idx") >= 0), ["value"]).filter(F.col("hour_idx") >= 47)
    seen = F.aggregate(F.map_values("neighbours"), F.lit(0).cast("long"), lambda acc, steps: acc + F.size(F.filter(steps, lambda s: s["value"].isNotNull())))
    return rows.select("station", "hour_idx", F.size("neighbours").cast("long").alias("neighbours"), seen.alias("observed_steps"))


@query("SELECT o_orderkey, " + ", ".join(f"CAST(coalesce(o_orderstatus = '{v}', false) AS INTEGER) AS status_{v}" for v in "FOP") + " FROM orders")
def one_hot(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", *scalars.one_hot(F.col("o_orderstatus"), list("FOP"), "status"))


@query(f"""WITH {PREDICTED}, g AS (SELECT target_idx, horizon, {", ".join(f"max(actual) FILTER (WHERE station = {s}) AS s{s}" for s in range(STATIONS))} FROM predicted GROUP BY ALL)
SELECT target_idx, CAST(horizon AS INTEGER) AS horizon, {", ".join(f"round(s{s}, 6) AS s{s}" for s in range(STATIONS))} FROM g""")
def group_pivot(spark, sf):
    rows = samples.grouped(predictions(spark, sf), list(range(STATIONS)))
    return rounded(rows.select("target_idx", "horizon", *[F.col(f"`{s}`").alias(f"s{s}") for s in range(STATIONS)]))


@query(f"WITH {PREDICTED} SELECT station, CAST(horizon AS INTEGER) AS horizon, target_idx, round(actual, 6) AS prediction FROM predicted WHERE actual IS NOT NULL")
def group_scatter(spark, sf):
    groups = samples.grouped(predictions(spark, sf), list(range(STATIONS)))
    return rounded(samples.scattered(groups, list(range(STATIONS))).select("station", "horizon", "target_idx", "prediction"))


@query(f"""WITH {SAMPLES} SELECT CAST(floor(origin_idx / 168) AS INTEGER) AS block, count(*) AS samples, CAST(min(origin_idx) AS INTEGER) AS first_origin, CAST(max(origin_idx) AS INTEGER) AS ceiling
  FROM candidates WHERE reason = 'eligible' GROUP BY 1""")
def chrono_blocks(spark, sf):
    return samples.reveal_blocks(samples.eligible(candidates(spark, sf)), 168)


@query(f"WITH {PREDICTED} SELECT station, horizon_ AS horizon, count(*) AS n, count(a) AS labelled FROM (SELECT station, CAST(horizon AS INTEGER) AS horizon_, CASE WHEN station <> 2 THEN actual END AS a FROM predicted) GROUP BY ALL")
def leave_one_out(spark, sf):
    return samples.withheld(predictions(spark, sf), 2).groupBy("station", "horizon").agg(F.count(F.lit(1)).alias("n"), F.count("actual").alias("labelled"))


#: The variable whose values over 50 count as rain, and the places of stations, which their numbers make.
RAIN, RANKS = "error", 3
OTHERS = [x for x in VARIABLES if x != TARGET]


def station_places(spark):
    s = F.col("id")
    return spark.range(STATIONS).select(s.cast("int").alias("place"), (s * 37 % 11 / 10.0 + 39.5).alias("lat"), (s * 53 % 13 / 10.0 + 116).alias("lon"))


def wide_panel(spark, sf):
    """station, hour_idx, code, the rain flag, and for each variable its filled values, scaled ones, masks and gap ages, stored."""
    cells = panel.gap_age(filled_panel(spark, sf))
    cells = panel.scaled(cells, panel.scaling_statistics(full_panel(spark, sf), TIME.train_end))
    parts = {"value": "filled", "scaled": "scaled", "observed": "observed", "gap_age": "gap_age"}
    found = cells.groupBy("station", "hour_idx").pivot("variable", VARIABLES).agg(*[F.first(c).alias(n) for n, c in parts.items()], F.first(scalars.occurred(F.col("value") - 50)).alias("occurred"))
    named = found.select("station", "hour_idx", F.col(f"{RAIN}_occurred"), *[c for x in VARIABLES for c in (F.col(f"{x}_value").alias(x), *[F.col(f"{x}_{n}") for n in ("scaled", "observed", "gap_age")])])
    coded = panel.categorical_fill(target_panel(spark, sf).withColumn("code", F.floor("value").cast("int") % 16), "code")
    return written(named.join(coded.select("station", "hour_idx", F.col("filled_code").alias("code")), ["station", "hour_idx"]), "wide")


WIDE = FILLED + f""", coded AS (SELECT station, hour_idx, CASE WHEN value IS NOT NULL THEN CAST(floor(value) AS INTEGER) % 16 END AS code FROM grid WHERE variable = '{TARGET}'
), codes AS (SELECT station, hour_idx, coalesce(last_value(code IGNORE NULLS) OVER (PARTITION BY station ORDER BY hour_idx RANGE BETWEEN 6 PRECEDING AND CURRENT ROW), 16) AS code FROM coded
), stats AS ({STATISTICS}), scaled AS (
  SELECT f.*, (filled - median) / coalesce(nullif(iqr, 0), nullif(std, 0)) AS scaled FROM filled f JOIN stats s ON s.variable = f.variable AND s.station IS NULL
), wide AS (SELECT s.station, s.hour_idx, any_value(code) AS code, CAST(coalesce(max(value) FILTER (WHERE variable = '{RAIN}') - 50 > 0, false) AS INTEGER) AS {RAIN}_occurred,
  {", ".join(f"max(filled) FILTER (WHERE variable = '{x}') AS {x}, max(scaled) FILTER (WHERE variable = '{x}') AS {x}_scaled, CAST(bool_or(observed) FILTER (WHERE variable = '{x}') AS INTEGER) AS {x}_observed, CAST(max(gap_age) FILTER (WHERE variable = '{x}') AS INTEGER) AS {x}_gap_age" for x in VARIABLES)}
  FROM scaled s JOIN codes c ON c.station = s.station AND c.hour_idx = s.hour_idx GROUP BY ALL
)"""
NEAR = f"""places AS (SELECT CAST(i AS INTEGER) AS place, i * 37 % 11 / 10.0 + 39.5 AS lat, i * 53 % 13 / 10.0 + 116 AS lon FROM range({STATIONS}) t(i)
), near AS (SELECT a.place AS station, b.place AS neighbour, row_number() OVER (PARTITION BY a.place ORDER BY pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), b.place) AS rank
  FROM places a JOIN places b ON a.place <> b.place QUALIFY rank <= {RANKS})"""


def stamp_sql(at):
    """The six cycles of an hour index, in the order of `features.CYCLES`."""
    ts = f"(TIMESTAMP '2024-01-01' + to_hours({at}_idx))"
    angles = {"hour": f"hour({ts}) * (2 * pi()) / 24", "doy": f"(dayofyear({ts}) - 1) * (2 * pi()) / dayofyear(make_date(year({ts}), 12, 31))", "month": f"(month({ts}) - 1) * (2 * pi()) / 12"}
    return {f"{at}_{c}_{f}": f"{f}({a})" for c, a in angles.items() for f in ("sin", "cos")}


def matrix_sql():
    """DuckDB: the relation matrix, regimes R0 to R3 under the columns of R3, nulls where a regime lacks a column."""
    full = lambda n, x: f"CASE WHEN count(*) OVER w{n} = {n} THEN {x} OVER w{n} END"
    own = {}
    for x in [TARGET, *OTHERS]:
        own |= {f"{x}_lag{k}": f"lag({x}, {k}) OVER w" for k in features.LAGS}
        own |= {f"{x}_{s}{n}": full(n, f"{f}({x})") for n in features.SPANS for s, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))}
        own |= {f"{x}_observed_lag0": f"{x}_observed", f"{x}_gap_age": f"{x}_gap_age"} | {f"{x}_observed_share{n}": full(n, f"avg({x}_observed)") for n in features.MASK_SPANS}
    base = {f"{RAIN}_occurred_lag0": f"{RAIN}_occurred"} | {f"{RAIN}_occurred_mean{n}": full(n, f"avg({RAIN}_occurred)") for n in features.SPANS} | {f"code_{k}": f"CAST(code = {k} AS INTEGER)" for k in range(17)}
    windows = ", ".join(["w AS (PARTITION BY station ORDER BY hour_idx)", *[f"w{n} AS (PARTITION BY station ORDER BY hour_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sorted({*features.SPANS, *features.MASK_SPANS})]])
    near = {f"near{r}_{n}": f"max({n}) FILTER (WHERE rank = {r})" for r in range(1, RANKS + 1) for n in (*[f"{TARGET}_lag{k}" for k in features.LAGS], f"{TARGET}_observed_lag0", f"{TARGET}_gap_age")}
    near = {k.replace(f"{TARGET}_observed", "observed").replace(f"{TARGET}_gap", "gap"): v for k, v in near.items()}
    at_sample = {f"station_{s}": f"CAST(s.station = {s} AS INTEGER)" for s in range(STATIONS)} | stamp_sql("origin") | stamp_sql("target")
    listed = lambda columns: ", ".join(f"{v} AS {k}" for k, v in columns.items())
    parts = []
    for regime in features.REGIMES:
        seen = set(features.sample_names(regime, TARGET, OTHERS, STATIONS, 17, RAIN, RANKS))
        columns = [f"{c}" if c in seen else f"NULL AS {c}" for c in (*own, *base, *at_sample, *near)]
        parts.append(f"SELECT '{regime}' AS regime, partition, station, CAST(horizon AS INTEGER) AS horizon, target_idx, CAST(origin_idx AS INTEGER) AS origin_idx, {', '.join(columns)} FROM joined")
    return f"""{WIDE}, {NEAR}, {SAMPLES.removeprefix(FILLED)[2:]}, at_origin AS (SELECT station, hour_idx, {listed(own | base)} FROM wide WINDOW {windows}
), nearby AS (SELECT n.station, o.hour_idx, {listed(near)} FROM near n JOIN at_origin o ON o.station = n.neighbour GROUP BY ALL
), joined AS (SELECT s.partition, s.horizon, s.target_idx, s.origin_idx, {listed(at_sample)}, o.*, n.* EXCLUDE (station, hour_idx)
  FROM candidates s JOIN at_origin o ON o.station = s.station AND o.hour_idx = s.origin_idx JOIN nearby n ON n.station = s.station AND n.hour_idx = s.origin_idx WHERE reason = 'eligible'
), matrix AS ({" UNION ALL ".join(parts)})"""


NAMES = features.sample_names("R3", TARGET, OTHERS, STATIONS, 17, RAIN, RANKS)
DOUBLES = [c for c in NAMES if not any(x in c for x in ("observed_lag0", "gap_age", "occurred_lag0", "code_", "station_"))]
MATRIX = matrix_sql()


def sample_matrices(spark, sf):
    """partition, regime and the columns of R3 over all eligible samples, from one stored panel and one matrix."""
    wide = wide_panel(spark, sf)
    chosen = samples.eligible(candidates(spark, sf))
    near = places.nearest(station_places(spark), RANKS)
    matrix = features.sample_matrix(wide, chosen, "R3", TARGET, OTHERS, STATIONS, scalars.MISSING_CODE + 1, TIME.start, RAIN, near, RANKS)
    whole = features.by_regime(matrix, {r: features.sample_names(r, TARGET, OTHERS, STATIONS, scalars.MISSING_CODE + 1, RAIN, RANKS) for r in features.REGIMES})
    return whole.withColumn("partition", TIME.partition(F.col("target_idx")))


@query(f"WITH {MATRIX} SELECT regime, station, horizon, target_idx, origin_idx, {', '.join(f'round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}' if c in DOUBLES else c for c in NAMES)} FROM matrix")
def feature_matrix_b3(spark, sf):
    """The matrices of regimes R0 to R3 over all eligible samples; columns that a regime lacks are null. Codes are those of `categorical_fill`."""
    rows = rounded(sample_matrices(spark, sf).drop("partition"))
    return rows.select(*[(F.col(c) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in rows.dtypes])  # no negative zeros


@query(f"WITH {MATRIX} {digest_sql('matrix', ['station', 'target_idx', *NAMES], DOUBLES, ['regime', 'partition', 'horizon'])}")
def feature_digests(spark, sf):
    """A digest of the feature matrix for each regime, partition and horizon, whatever the order of its rows."""
    return table_digest(sample_matrices(spark, sf), ["station", "target_idx", *NAMES], ["regime", "partition", "horizon"])


#: Channels of the sequences of each regime: all values, and those with gap ages.
SEQUENCES = {"R0": (["click", "error"], []), "R1": ([TARGET, "click", "error"], [TARGET]), "R2": ([TARGET, "signup", "view", "click", "error"], [TARGET, "signup", "view"])}


def tensor_sql():
    """DuckDB: sums of each sample's tensors by place, from its 48 hours and from its own columns."""
    step = lambda x: steps_sql(f"CAST(CAST({x} AS FLOAT) AS DOUBLE)")
    fixed = [*[f"CAST(station = {s} AS INTEGER)" for s in range(STATIONS)], *[f"CAST(horizon = {h} AS INTEGER)" for h in samples.HORIZONS], *stamp_sql("origin").values(), *stamp_sql("target").values()]
    static = " + ".join(f"{i} * {step(x)}" for i, x in enumerate(fixed, 1))
    parts = []
    for regime, (numeric, aged) in SEQUENCES.items():
        own = [*[f"{x}_scaled" for x in numeric], *[f"{x}_observed" for x in numeric], *[f"{x}_gap_age / 168.0" for x in aged], f"{RAIN}_occurred", *[f"CAST(code = {k} AS INTEGER)" for k in range(17)]]
        total = " + ".join(f"((w.hour_idx - s.origin_idx + 47) * {len(own)} + {i}) * {step(x)}" for i, x in enumerate(own, 1))
        parts.append(f"SELECT '{regime}' AS regime, sample_id, {len(own)} AS channels, CAST(sum({total}) AS BIGINT) AS dynamic_sum, any_value(static_sum) AS static_sum FROM s JOIN wide w ON w.station = s.station AND w.hour_idx BETWEEN s.origin_idx - 47 AND s.origin_idx GROUP BY ALL")
    ident = "partition || '|' || station || '|' || strftime(TIMESTAMP '2024-01-01' + to_hours(target_idx), '%Y%m%d%H') || '|h' || horizon"
    return f"WITH {WIDE}, {SAMPLES.removeprefix(FILLED)[2:]}, s AS (SELECT {ident} AS sample_id, station, origin_idx, {static} AS static_sum FROM candidates WHERE reason = 'eligible') {' UNION ALL '.join(parts)}"


@query(tensor_sql())
def sample_tensors(spark, sf):
    """Sequences of 48 hours and static channels of all samples by regime, told apart by sums over their places."""
    wide = wide_panel(spark, sf)
    chosen = samples.eligible(candidates(spark, sf)).select("sample_id", "station", "horizon", "target_idx", "origin_idx")
    static = features.static_vector(list(range(STATIONS)), samples.HORIZONS, TIME.start)
    made = []
    for regime, (numeric, aged) in SEQUENCES.items():
        rows = features.tensors(wide, chosen, features.dynamic_vector(numeric, aged, RAIN, 17), static)
        made.append(rows.select(F.lit(regime).alias("regime"), "sample_id", F.get("shape", F.lit(1)).alias("channels"), features.checksum(F.col("dynamic")).alias("dynamic_sum"), features.checksum(F.col("static")).alias("static_sum")))
    return made[0].unionByName(made[1]).unionByName(made[2])
