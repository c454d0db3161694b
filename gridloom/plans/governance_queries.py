"""Queries over digests, drift, extremes, penalties and shortlists."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import governance, metrics
from gridloom.plans.base import ERRORS, MAE, errors, query, rounded
from gridloom.sources.tables import table

CELLS = f"c AS (SELECT model, station, horizon, {MAE} AS mae FROM errors GROUP BY ALL)"


@query(f"""WITH {ERRORS}, s AS (SELECT model, station, {MAE} AS mae FROM errors GROUP BY ALL)
SELECT model, first(station ORDER BY mae, station) AS easiest, round(min(mae), 6) AS least, first(station ORDER BY mae DESC, station) AS hardest, round(max(mae), 6) AS highest FROM s GROUP BY ALL""")
def easiest_hardest(spark, sf):
    return rounded(governance.extremes(metrics.cells(errors(spark, sf), ("model", "station")), "mae", ["model"], "station"))


@query(f"""WITH {ERRORS}, {CELLS}, d AS (SELECT f.mae AS f, h.mae - f.mae AS d FROM c f JOIN c h ON f.station = h.station AND f.horizon = h.horizon AND f.model = 'b0' AND h.model = 'b2')
SELECT count(*) AS n, round(avg(d), 6) AS penalty, round(avg(d * 100 / nullif(f, 0)), 6) AS penalty_pct, count(*) FILTER (WHERE d > 0) AS worse FROM d""")
def held_out_penalty(spark, sf):
    cells = metrics.cells(errors(spark, sf))
    side = lambda m: cells.filter(F.col("model") == m)
    return rounded(governance.penalties(side("b0"), side("b2"), "mae", ["station", "horizon"]))


@query(f"""WITH {ERRORS}, {CELLS}, u AS (SELECT model, 0 AS origin, mae FROM c WHERE model = 'b0' UNION ALL SELECT model, 1, mae FROM c WHERE model <> 'b0')
SELECT model, origin, round(avg(mae), 6) AS mean, count(*) AS runs FROM u GROUP BY ALL""")
def shortlist(spark, sf):
    cells = metrics.cells(errors(spark, sf)).select("model", "mae")
    return rounded(governance.shortlist([cells.filter(F.col("model") == "b0"), cells.filter(F.col("model") != "b0")], "mae"))


@query("SELECT o_custkey, count(*) AS steps, first(o_totalprice ORDER BY o_orderkey) AS first, first(o_totalprice ORDER BY o_orderkey DESC) AS last FROM orders GROUP BY ALL")
def training_summary(spark, sf):
    """Orders of a customer stand for the epochs of a run."""
    return governance.training_summary(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice")


@query("""SELECT r_name AS name, CASE WHEN r_regionkey = 0 THEN 'removed' WHEN r_regionkey = 1 THEN 'changed' ELSE 'same' END AS status FROM region UNION ALL SELECT 'NEW', 'added'""")
def digest_drift(spark, sf):
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("r_regionkey")
    after = nations.filter(key != 0).withColumn("n_name", F.when(key == 1, F.lower("n_name")).otherwise(F.col("n_name")))
    after = after.unionByName(nations.filter(key == 2).withColumn("r_name", F.lit("NEW")))
    made = lambda rows: governance.artifact_digests(rows, "r_name", ["n_nationkey", "n_name"])
    return governance.drift(made(nations), made(after))


@query(f"WITH {ERRORS} SELECT model, round({MAE}, 6) AS mae FROM errors GROUP BY ALL")
def reconciled_scores(spark, sf):
    """The same score by two ways must agree to 1e-9, or the query fails."""
    e = errors(spark, sf)
    direct = e.groupBy("model").agg(F.avg(F.abs("residual")).alias("mae"))
    by_cell = metrics.cells(e).groupBy("model").agg((F.sum(F.col("mae") * F.col("n")) / F.sum("n")).alias("locked"))
    return rounded(governance.reconciled(direct.join(by_cell, "model"), F.col("mae"), F.col("locked")).select("model", "mae"))
