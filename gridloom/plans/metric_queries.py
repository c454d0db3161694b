"""Queries over errors of the baselines, severe events and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.scalars import season
from gridloom.operators import compare, events, metrics, stats
from gridloom.plans.base import (
    ALL_ERRORS, ERRORS, FILLED, GRID, LOW, MAE, MODELS, PREDICTED, R2, RMSE, SEVERE, SUMMARY, TARGET, UNDER, corr_sql, errors, predictions, query, rounded, target_panel, tested,
)

H = "CAST(horizon AS INTEGER) AS horizon"
CELLS = f"cells AS (SELECT model, station, horizon, count(*) AS n, {MAE} AS mae, {RMSE} AS rmse, {R2} AS r2 FROM errors GROUP BY ALL)"


@query(f"WITH {ERRORS}, {CELLS} SELECT model, station, {H}, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM cells WHERE model = 'b0'")
def b0_cell_metrics(spark, sf):
    return rounded(metrics.cells(errors(spark, sf).filter(F.col("model") == "b0")))


@query(f"WITH {ERRORS}, {CELLS} SELECT model, station, {H}, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM cells")
def cell_metrics(spark, sf):
    return rounded(metrics.cells(errors(spark, sf)))


@query(f"""WITH {ERRORS}, {CELLS}, macro AS (SELECT model, count(*) AS cells, avg(mae) AS macro_mae, avg(rmse) AS macro_rmse, avg(r2) AS macro_r2 FROM cells GROUP BY ALL)
, micro AS (SELECT model, count(*) AS n, {MAE} AS micro_mae, {RMSE} AS micro_rmse, {R2} AS micro_r2 FROM errors GROUP BY ALL)
SELECT model, cells, round(macro_mae, 6) AS macro_mae, round(macro_rmse, 6) AS macro_rmse, round(macro_r2, 6) AS macro_r2, n, round(micro_mae, 6) AS micro_mae, round(micro_rmse, 6) AS micro_rmse, round(micro_r2, 6) AS micro_r2
FROM macro JOIN micro USING (model)""")
def macro_metrics(spark, sf):
    return rounded(metrics.macro(errors(spark, sf)))


@query(f"""WITH {ERRORS}, s AS (SELECT model, station, {MAE} AS mae, {RMSE} AS rmse FROM errors GROUP BY ALL)
SELECT model, round(avg(mae), 6) AS macro_station_mae, round(avg(rmse), 6) AS macro_station_rmse FROM s GROUP BY ALL""")
def macro_station_metrics(spark, sf):
    return rounded(metrics.macro_station(errors(spark, sf)))


@query(f"""WITH {ERRORS}, c AS (SELECT model, station, horizon, count(*) FILTER (WHERE actual > {SEVERE}) AS sn, avg(abs(residual)) FILTER (WHERE actual > {SEVERE}) AS smae FROM errors GROUP BY ALL)
, w AS (SELECT model, count(*) AS severe_n, {MAE} AS severe_mae, {RMSE} AS severe_rmse, avg(residual) AS severe_mean_residual, {UNDER} AS severe_under_pct FROM errors WHERE actual > {SEVERE} GROUP BY ALL)
SELECT model, severe_n, round(severe_mae, 6) AS severe_mae, round(severe_rmse, 6) AS severe_rmse, round(severe_mean_residual, 6) AS severe_mean_residual, round(CAST(severe_under_pct AS DOUBLE), 6) AS severe_under_pct,
  round(avg(smae), 6) AS severe_macro_mae, count(*) FILTER (WHERE sn > 0) AS cells_contributing, count(*) AS cells_total, count(*) FILTER (WHERE sn = 0) AS cells_empty
FROM w JOIN c USING (model) GROUP BY ALL""")
def severe_metrics(spark, sf):
    return rounded(metrics.severe(errors(spark, sf), SEVERE))


@query(f"""WITH {ERRORS}, t AS (SELECT e.model, e.horizon, e.residual AS r, abs(e.residual) AS e, abs(b.residual) AS base FROM errors e
  JOIN errors b ON b.model = 'b0' AND b.station = e.station AND b.horizon = e.horizon AND b.target_idx = e.target_idx WHERE e.actual > {SEVERE})
SELECT model, {H}, count(*) AS severe_n, round(avg(e), 6) AS mae, round(sqrt(avg(r * r)), 6) AS rmse, round(avg(r), 6) AS mean_residual, round(quantile_cont(r, 0.5), 6) AS median_residual,
  round(CAST(100.0 * count(*) FILTER (WHERE r > 0) / count(*) AS DOUBLE), 6) AS underprediction_pct, round(quantile_cont(e, 0.5), 6) AS median_abs_error, round(quantile_cont(e, 0.9), 6) AS p90_abs_error,
  round(quantile_cont(e, 0.95), 6) AS p95_abs_error, round(avg(e - base), 6) + 0.0 AS mean_diff_vs_baseline FROM t GROUP BY ALL""")
def severe_tail(spark, sf):
    return rounded(metrics.severe_tail(tested(spark, sf), SEVERE, MODELS, "b0"))


@query(f"""WITH {ERRORS}, c AS (SELECT model, horizon, count(*) FILTER (WHERE actual > {SEVERE} AND prediction > {SEVERE}) AS tp, count(*) FILTER (WHERE actual <= {SEVERE} AND prediction > {SEVERE}) AS fp,
  count(*) FILTER (WHERE actual <= {SEVERE} AND prediction <= {SEVERE}) AS tn, count(*) FILTER (WHERE actual > {SEVERE} AND prediction <= {SEVERE}) AS fn FROM errors GROUP BY ALL)
, s AS (SELECT *, tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS p, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS r, tn / nullif(CAST(tn + fp AS DOUBLE), 0) AS sp FROM c)
SELECT model, {H}, tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(sp, 6) AS specificity, round(CASE WHEN p > 0 OR r > 0 THEN 2 * p * r / (p + r) END, 6) AS f1 FROM s""")
def severe_detection(spark, sf):
    return rounded(metrics.detection(errors(spark, sf), SEVERE))


@query(f"""WITH {ERRORS}, s AS (SELECT *, CASE WHEN actual <= {LOW} THEN 'LOW' WHEN actual <= {SEVERE} THEN 'ELEVATED' ELSE 'SEVERE' END AS stratum FROM errors)
SELECT model, stratum, count(*) AS n, round({MAE}, 6) AS mae, round({RMSE}, 6) AS rmse, round(avg(residual), 6) AS mean_residual, round(CAST({UNDER} AS DOUBLE), 6) AS underprediction_pct,
  round(quantile_cont(abs(residual), 0.5), 6) AS median_abs_error, round(quantile_cont(abs(residual), 0.9), 6) AS p90_abs_error FROM s GROUP BY ALL""")
def concentration_strata(spark, sf):
    return rounded(metrics.strata(errors(spark, sf), LOW, SEVERE))


@query(f"""WITH {ERRORS}, g AS (SELECT model, horizon, station, grouping(horizon) AS gh, grouping(station) AS gs, count(*) AS n, count(*) FILTER (WHERE prediction < 20.0) AS n_below, min(prediction) AS m
  FROM errors GROUP BY GROUPING SETS ((model), (model, horizon), (model, station)))
SELECT model, CASE WHEN gh = 1 AND gs = 1 THEN 'overall' WHEN gh = 0 THEN 'horizon' ELSE 'station' END AS scope, CASE WHEN gh = 1 AND gs = 1 THEN '' WHEN gh = 0 THEN CAST(horizon AS VARCHAR) ELSE CAST(station AS VARCHAR) END AS key,
  n, n_below, round(CAST(100.0 * n_below / n AS DOUBLE), 6) AS pct_below, round(m, 6) AS min_prediction FROM g""")
def negative_scopes(spark, sf):
    """Event values are positive, so the bound is 20 here."""
    return rounded(metrics.negative_scopes(errors(spark, sf), 20.0))


@query(f"""WITH {ERRORS}, c AS (SELECT model, horizon, count(*) AS n, {MAE} AS mae, {RMSE} AS rmse FROM errors GROUP BY ALL), b AS (SELECT horizon, mae AS base FROM c WHERE model = 'b0')
SELECT model, {H}, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mae - base, 6) AS diff, round((base - mae) * 100 / nullif(base, 0), 6) + 0.0 AS improvement_pct FROM c JOIN b USING (horizon)""")
def horizon_vs_baseline(spark, sf):
    return rounded(metrics.against_baseline(errors(spark, sf), "b0"))


@query(f"WITH {ERRORS} SELECT model, station, {SUMMARY}, count(*) FILTER (WHERE actual > {SEVERE}) AS severe_n, round(avg(abs(residual)) FILTER (WHERE actual > {SEVERE}), 6) AS severe_mae FROM errors GROUP BY ALL")
def station_table(spark, sf):
    over = F.when(F.col("actual") > SEVERE, F.abs("residual"))
    rows = errors(spark, sf).withColumn("_over", over)
    whole = metrics.summary(rows, ["model", "station"])
    return rounded(whole.join(rows.groupBy("model", "station").agg(F.count("_over").alias("severe_n"), F.avg("_over").alias("severe_mae")), ["model", "station"]))


@query("""WITH o AS (SELECT month(o_orderdate) AS m, o_totalprice AS actual, o_totalprice - (SELECT quantile_cont(o_totalprice, 0.5) FROM orders) AS residual, o_orderpriority AS model FROM orders)
SELECT model, CASE WHEN m IN (12, 1, 2) THEN 'DJF' WHEN m IN (3, 4, 5) THEN 'MAM' WHEN m IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, count(*) AS n, round(avg(abs(residual)), 4) AS mae, round(sqrt(avg(residual * residual)), 4) AS rmse FROM o GROUP BY ALL""")
def seasonal_table(spark, sf):
    """Orders span all months; the prediction is the median price."""
    from gridloom.functions.aggregates import mae, rmse
    from gridloom.operators.stats import quantiles
    from gridloom.sources.tables import table

    orders = table(spark, sf, "orders").select(F.month("o_orderdate").alias("month"), F.col("o_totalprice").alias("actual"), F.col("o_orderpriority").alias("model"))
    rows = orders.join(F.broadcast(quantiles(orders, "actual", [], {"prediction": 0.5}))).withColumn("residual", F.col("actual") - F.col("prediction"))  # one row is broadcast
    r = F.col("residual")
    return rows.groupBy("model", season(F.col("month")).alias("season")).agg(F.count(F.lit(1)).alias("n"), F.round(mae(r), 4).alias("mae"), F.round(rmse(r), 4).alias("rmse"))


@query(f"WITH {ERRORS} SELECT model, {H}, CAST(hour AS INTEGER) AS hour, {SUMMARY} FROM errors GROUP BY model, horizon, hour")
def hour_of_day(spark, sf):
    return rounded(metrics.summary(errors(spark, sf), ["model", "horizon", "hour"]))


@query(f"""WITH {ERRORS}, {CELLS}, m AS (SELECT model, avg(mae) AS macro_mae FROM cells GROUP BY ALL), u AS (SELECT model, {MAE} AS micro_mae FROM errors GROUP BY ALL)
SELECT model, round(macro_mae, 6) AS macro_mae, round(micro_mae, 6) AS micro_mae, CAST(row_number() OVER (ORDER BY macro_mae, model) AS INTEGER) AS rank FROM m JOIN u USING (model)""")
def leaderboard(spark, sf):
    return rounded(metrics.leaderboard(errors(spark, sf)))


@query(f"""WITH {ALL_ERRORS}, g AS (SELECT model, partition, {MAE} AS mae FROM all_errors WHERE partition <> 'train' GROUP BY ALL)
SELECT model, round(v.mae, 6) AS before, round(t.mae, 6) AS after, round(t.mae - v.mae, 6) AS change, round((t.mae - v.mae) * 100 / nullif(v.mae, 0), 6) AS change_pct
FROM (SELECT * FROM g WHERE partition = 'validation') v FULL JOIN (SELECT * FROM g WHERE partition = 'test') t USING (model)""")
def generalization_gap(spark, sf):
    rows = metrics.cells(errors(spark, sf, None), ("model", "partition"))
    side = lambda p: rows.filter(F.col("partition") == p)
    return rounded(metrics.generalization_gap(side("validation"), side("test"), "mae"))


EVENTS = f"""t AS (SELECT * FROM grid WHERE variable = '{TARGET}'), f AS (SELECT station, hour_idx, value, hour_idx - row_number() OVER (PARTITION BY station ORDER BY hour_idx) AS island FROM t WHERE value > {SEVERE})
, ev0 AS (SELECT station, island, min(hour_idx) AS start, max(hour_idx) AS "end", count(*) AS duration, avg(value) AS mean, max(value) AS peak, CAST(first(hour_idx ORDER BY value DESC, hour_idx) AS INTEGER) AS peak_hour FROM f GROUP BY ALL)
, ev AS (SELECT *, CAST(row_number() OVER (PARTITION BY station ORDER BY start) AS INTEGER) AS event FROM ev0)"""


@query(f'WITH {GRID}, {EVENTS} SELECT station, event, start, "end", duration, round(mean, 6) AS mean, round(peak, 6) AS peak, peak_hour FROM ev')
def severe_events(spark, sf):
    return rounded(events.severe_events(target_panel(spark, sf), SEVERE))


@query(f"""WITH {ERRORS}, {EVENTS.replace("t AS", "tt AS").replace("FROM t ", "FROM tt ")}
SELECT e.station, event, model, {H}, count(*) AS n, round({MAE}, 6) AS mae, round(avg(residual), 6) AS mean_residual, round(max(prediction) FILTER (WHERE target_idx = peak_hour), 6) AS prediction_at_peak,
  round(max(residual) FILTER (WHERE target_idx = peak_hour), 6) AS residual_at_peak, coalesce(bool_or(target_idx = start AND prediction > {SEVERE}), false) AS flagged_at_start, count(*) FILTER (WHERE prediction > {SEVERE}) AS predicted_severe_hours
FROM errors e JOIN ev ON ev.station = e.station AND target_idx BETWEEN start AND "end" GROUP BY e.station, event, model, horizon""")
def event_model_metrics(spark, sf):
    return rounded(events.event_metrics(events.severe_events(target_panel(spark, sf), SEVERE), errors(spark, sf), SEVERE))


@query(f"""WITH {GRID}, {EVENTS} SELECT station, count(*) AS events, round(avg(duration), 6) AS mean_duration, max(duration) AS longest, round(max(peak), 6) AS highest_peak, first(start ORDER BY peak DESC, start) AS highest_start FROM ev GROUP BY ALL""")
def event_statistics(spark, sf):
    return rounded(events.event_statistics(events.severe_events(target_panel(spark, sf), SEVERE)))


PAIRS = """p AS (SELECT unnest([{'x': 'b0', 'y': 'b1', 'a': abs(actual - b0), 'b': abs(actual - b1)}, {'x': 'b0', 'y': 'b2', 'a': abs(actual - b0), 'b': abs(actual - b2)}, {'x': 'b1', 'y': 'b2', 'a': abs(actual - b1), 'b': abs(actual - b2)}]) AS s
  FROM predicted WHERE partition = 'test'), q AS (SELECT s.x AS model_a, s.y AS model_b, s.a AS a, s.b AS b FROM p)
, k AS (SELECT *, rank() OVER (PARTITION BY model_a, model_b ORDER BY a) + (count(*) OVER (PARTITION BY model_a, model_b, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY model_a, model_b ORDER BY b) + (count(*) OVER (PARTITION BY model_a, model_b, b) - 1) / 2.0 AS rb FROM q)"""


@query(f"""WITH {PREDICTED}, {PAIRS} SELECT model_a, model_b, count(*) AS n, round({corr_sql("a", "b")}, 6) AS pearson, round({corr_sql("ra", "rb")}, 6) AS spearman, round(avg(a - b), 6) AS mean_diff, round(quantile_cont(a - b, 0.5), 6) + 0.0 AS median_diff,
  round(CAST(100.0 * count(*) FILTER (WHERE a < b) / count(*) AS DOUBLE), 6) AS a_better_pct, round(CAST(100.0 * count(*) FILTER (WHERE b < a) / count(*) AS DOUBLE), 6) AS b_better_pct, round(CAST(100.0 * count(*) FILTER (WHERE a = b) / count(*) AS DOUBLE), 6) AS tied_pct FROM k GROUP BY ALL""")
def complementarity(spark, sf):
    return rounded(compare.complementarity(tested(spark, sf), MODELS))


@query(f"""WITH {PREDICTED}, e AS (SELECT abs(actual - b0) AS e0, abs(actual - b1) AS e1, abs(actual - b2) AS e2 FROM predicted WHERE partition = 'test'), m AS (SELECT *, least(e0, e1, e2) AS l FROM e)
, w AS (SELECT *, CAST(e0 = l AS INTEGER) + CAST(e1 = l AS INTEGER) + CAST(e2 = l AS INTEGER) AS k FROM m)
SELECT count(*) AS n, {", ".join(f"round(CAST(100.0 * count(*) FILTER (WHERE e{i} = l AND k = 1) / count(*) AS DOUBLE), 6) AS b{i}_best_pct" for i in range(3))}, round(CAST(100.0 * count(*) FILTER (WHERE k > 1) / count(*) AS DOUBLE), 6) AS tie_pct FROM w""")
def best_of_n(spark, sf):
    return rounded(compare.best_of(tested(spark, sf), MODELS))


@query(f"""WITH {ERRORS}, c AS (SELECT horizon, model, {MAE} AS mae FROM errors GROUP BY ALL), g AS (SELECT horizon, max(mae) FILTER (WHERE model = 'b0') AS before, max(mae) FILTER (WHERE model = 'b2') AS after FROM c GROUP BY ALL)
SELECT {H}, round(before, 6) AS before, round(after, 6) AS after, round(before - after, 6) AS gain, round((before - after) * 100 / nullif(before, 0), 6) AS gain_pct FROM g""")
def regime_gain(spark, sf):
    return rounded(compare.gain(metrics.cells(errors(spark, sf), ("model", "horizon")), "mae", "b0", "b2", ["horizon"]))


@query(f"""WITH {ERRORS}, c AS (SELECT station, horizon, model, {MAE} AS mae FROM errors GROUP BY ALL), g AS (SELECT station, horizon, max(mae) FILTER (WHERE model = 'b0') AS before, max(mae) FILTER (WHERE model = 'b1') AS after FROM c GROUP BY ALL)
SELECT station, {H}, round(before - after, 6) AS gain, CASE WHEN before - after > 0 THEN 'win' WHEN before - after < 0 THEN 'loss' WHEN before - after = 0 THEN 'tie' END AS verdict FROM g""")
def win_loss_tie(spark, sf):
    return rounded(compare.verdicts(metrics.cells(errors(spark, sf)), "mae", "b0", "b1", ["station", "horizon"]).select("station", "horizon", "gain", "verdict"))


#: Seeds are stations here: five of them would be five refits.
SEEDS = f"seeds AS (SELECT model, horizon, station AS seed, {MAE} AS mae FROM errors GROUP BY ALL)"


@query(f"WITH {ERRORS}, {SEEDS} SELECT model, {H}, count(*) AS seeds, round(avg(mae), 6) AS mean, round(stddev_samp(mae), 6) AS std, round(min(mae), 6) AS min, round(max(mae), 6) AS max, round(max(mae) - min(mae), 6) AS range FROM seeds GROUP BY ALL")
def seed_summary(spark, sf):
    return rounded(compare.seed_summary(metrics.cells(errors(spark, sf)), "mae", ["model", "horizon"]))


@query(f"""WITH {ERRORS}, {SEEDS}, d AS (SELECT horizon, seed, max(mae) FILTER (WHERE model = 'b2') - max(mae) FILTER (WHERE model = 'b0') AS d FROM seeds GROUP BY ALL)
SELECT {H}, count(d) AS n, round(avg(d), 6) AS mean_diff, round(avg(d) - {compare.T_95_DF4} * stddev_samp(d) / sqrt(count(d)), 6) AS low, round(avg(d) + {compare.T_95_DF4} * stddev_samp(d) / sqrt(count(d)), 6) AS high,
  count(*) FILTER (WHERE d < 0) AS better, count(*) FILTER (WHERE d > 0) AS worse, count(*) FILTER (WHERE d < 0) = count(d) OR count(*) FILTER (WHERE d > 0) = count(d) AS same_direction FROM d GROUP BY ALL""")
def paired_interval(spark, sf):
    scores = metrics.cells(errors(spark, sf)).withColumnRenamed("station", "seed")
    return rounded(compare.paired_interval(scores, "mae", "b0", "b2", ["horizon"]))


@query(f"""WITH {ERRORS}, c AS (SELECT model, station, horizon, {MAE} AS mae, {RMSE} AS rmse FROM errors GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY round(mae / 1e-12), round(rmse / 1e-12), station, model) AS k FROM c)
SELECT {H}, station, model, round(mae, 6) AS mae FROM r WHERE k = 1""")
def candidate_select(spark, sf):
    return rounded(compare.selected(metrics.cells(errors(spark, sf)), ["horizon"], ["station", "model"]).select("horizon", "station", "model", "mae"))


@query(f"""WITH {ERRORS}, l AS (SELECT a.model, a.station, a.horizon, v.lag, count(*) AS pairs, {corr_sql("a.residual", "b.residual", 30)} AS r FROM errors a CROSS JOIN (VALUES (1), (6), (24)) v(lag)
  JOIN errors b ON b.model = a.model AND b.station = a.station AND b.horizon = a.horizon AND b.target_idx = a.target_idx - v.lag GROUP BY ALL)
SELECT model, station, {H}, CAST(lag AS INTEGER) AS lag, pairs, round(r, 6) AS r FROM l""")
def residual_acf(spark, sf):
    return rounded(residual_correlations(spark, sf))


def residual_correlations(spark, sf, lags=(1, 6, 24)):
    """Samples of a cell aren't dense in time, so residuals meet those of an earlier target hour by an equi-join."""
    from gridloom.functions.aggregates import correlation

    rows = errors(spark, sf).select("model", "station", "horizon", "target_idx", "residual")
    now = rows.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("_then", F.col("target_idx") - F.col("lag"))
    then = rows.select("model", "station", "horizon", F.col("target_idx").alias("_then"), F.col("residual").alias("y"))
    both = now.join(then, ["model", "station", "horizon", "_then"])
    return both.groupBy("model", "station", "horizon", "lag").agg(F.count(F.lit(1)).alias("pairs"), correlation(F.col("residual"), F.col("y"), 30).alias("r"))


@query(f"""WITH {ERRORS}, l AS (SELECT a.model, a.station, a.horizon, v.lag, {corr_sql("a.residual", "b.residual", 30)} AS r FROM errors a CROSS JOIN (VALUES (1), (6), (24)) v(lag)
  JOIN errors b ON b.model = a.model AND b.station = a.station AND b.horizon = a.horizon AND b.target_idx = a.target_idx - v.lag GROUP BY ALL)
SELECT model, {H}, CAST(lag AS INTEGER) AS lag, count(r) AS n, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS median, round(min(r), 6) AS min, round(max(r), 6) AS max,
  round(quantile_cont(r, 0.25), 6) AS q25, round(quantile_cont(r, 0.75), 6) AS q75, round(quantile_cont(r, 0.75) - quantile_cont(r, 0.25), 6) AS iqr FROM l GROUP BY ALL""")
def acf_summary(spark, sf):
    return rounded(stats.spread(residual_correlations(spark, sf), "r", ["model", "horizon", "lag"]))


@query(f"""WITH {FILLED}, f AS (SELECT station, variable, count(*) AS n FROM grid WHERE NOT observed GROUP BY ALL) SELECT station, variable, n FROM f""")
def missing_hours(spark, sf):
    from gridloom.plans.base import full_panel

    return full_panel(spark, sf).filter(~F.col("observed")).groupBy("station", "variable").agg(F.count(F.lit(1)).alias("n"))


MILLIONTHS = " || ',' || ".join(f"coalesce(CAST(CAST(round({m} * 1000000) AS BIGINT) AS VARCHAR), '')" for m in MODELS)


@query(f"""WITH {PREDICTED}, locked AS (
  SELECT CAST('0x' || substr(md5(partition || '|' || station || '|' || strftime(TIMESTAMP '2024-01-01' + to_hours(target_idx), '%Y%m%d%H') || '|h' || horizon || ',' || {MILLIONTHS}), 1, 15) AS BIGINT) AS h
  FROM predicted
) SELECT count(*) AS predictions, bit_xor(h) AS xor_digest, CAST(sum(h) AS VARCHAR) AS sum_digest FROM locked""")
def prediction_lock(spark, sf):
    """Count and order-free digest of all predictions to the millionth, taken before any actual is read: partial sums, one row a task."""
    text = F.concat_ws(",", "sample_id", *[F.coalesce(F.round(F.col(m) * 1000000).cast("long").cast("string"), F.lit("")) for m in MODELS])
    row = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return predictions(spark, sf).agg(F.count(F.lit(1)).alias("predictions"), F.bit_xor(row).alias("xor_digest"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("sum_digest"))
