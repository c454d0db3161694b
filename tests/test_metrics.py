"""Literal cases of metrics, audit, events and comparison."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import audit, compare, events, metrics, stats
from gridloom.operators import places as maps

SCHEMA = "model string, station string, horizon int, actual double, prediction double"


def errors(spark, actual, predicted, station, horizon):
    rows = [("m", s, h, float(a), float(p)) for a, p, s, h in zip(actual, predicted, station, horizon, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("residual", F.col("actual") - F.col("prediction"))


def test_macro_differs_from_micro(spark):
    e = errors(spark, [10, 20, 30, 0, 0, 0, 100], [12, 22, 33, 1, 1, 1, 90], "AAABBBB", [1, 1, 1, 1, 1, 1, 6])
    row = metrics.macro(e).first()
    assert row.macro_mae == pytest.approx((7 / 3 + 1 + 10) / 3) and row.micro_mae == pytest.approx(20 / 7) and row.cells == 3
    assert {(r.station, r.horizon): r.r2 for r in metrics.cells(e).collect()}["B", 1] is None
    e = errors(spark, [10, 20, 0, 0], [11, 21, 5, 5], "AABB", [1] * 4)
    assert metrics.macro_station(e).first().macro_station_mae == 3.0


def test_severe(spark):
    e = errors(spark, [244.0, 244.1, 300], [0, 0, 0], "AAA", [1] * 3)
    assert metrics.severe(e, 244.0).first().severe_n == 2
    e = errors(spark, [300] * 4, [100, 100, 100, 400], "AAAA", [1] * 4)
    assert metrics.severe(e, 244.0).first().severe_under_pct == 75.0
    row = metrics.severe(errors(spark, [300, 10], [1, 1], "AB", [1, 1]), 244.0).first()
    assert (row.cells_contributing, row.cells_total, row.cells_empty) == (1, 2, 1)


def test_severe_without_severe_rows(spark):
    both = errors(spark, [300, 10], [1, 1], "AA", [1, 1]).union(errors(spark, [10, 244], [1, 1], "AB", [1, 1]).withColumn("model", F.lit("none")))
    assert [(r.model, r.severe_n) for r in metrics.severe(both, 244.0).collect()] == [("m", 1)]
    assert metrics.severe(both.filter("model = 'none'"), 244.0).count() == 0


def test_severe_tail_counts_predictions_only(spark):
    wide = spark.createDataFrame([(1, 100.0, 90.0, 80.0), (1, 120.0, 130.0, None), (1, 110.0, 100.0, None), (1, 90.0, None, 95.0), (6, 99.0, 98.0, None)], "horizon int, actual double, b0 double, b2 double")
    rows = {(r.model, r.horizon): r for r in metrics.severe_tail(wide, 80.0, ("b0", "b2"), "b0").collect()}
    assert set(rows) == {("b0", 1), ("b0", 6), ("b2", 1)}
    assert (rows["b2", 1].severe_n, rows["b2", 1].underprediction_pct, rows["b2", 1].mean_diff_vs_baseline) == (1, 100.0, 10.0)
    assert (rows["b0", 1].severe_n, rows["b0", 1].underprediction_pct) == (3, pytest.approx(200 / 3))


def test_negatives(spark):
    row = metrics.negative_scopes(errors(spark, [0] * 4, [-5, 1, 2, 3], "AAAA", [1] * 4)).filter("scope = 'overall'").first()
    assert (row.n_below, row.pct_below, row.min_prediction) == (1, 25.0, -5.0)


def test_detection_without_positives(spark):
    row = metrics.detection(errors(spark, [1, 2], [1, 2], "AA", [1, 1]), 244.0).first()
    assert (row.tp, row.fp, row.tn, row.fn) == (0, 0, 2, 0) and row.precision is None and row.recall is None and row.f1 is None and row.specificity == 1.0


def test_events_end_at_missing_hours(spark):
    values = [5, 300, 400, 400, None, 300, 5]
    rows = spark.createDataFrame([("s", i, None if v is None else float(v)) for i, v in enumerate(values)], "station string, hour_idx int, value double")
    got = events.severe_events(rows, 244.0).orderBy("start").collect()
    assert [(r.start, r.end, r.duration, r.peak, r.peak_hour, r.event) for r in got] == [(1, 3, 3, 400.0, 2, 1), (5, 5, 1, 300.0, 5, 2)]


def test_runs_and_summary(spark):
    flags = [1, 0, 0, 1, 0, 1, 1]
    rows = spark.createDataFrame([("s", "v", i, bool(f)) for i, f in enumerate(flags)], "station string, variable string, hour_idx int, observed boolean")
    found = audit.runs(rows, ~F.col("observed"), ("station", "variable"))
    assert sorted((r.start, r.length) for r in found.collect()) == [(1, 2), (4, 1)]
    empty = audit.run_summary(rows.filter("observed"), found.limit(0), [["variable"]]).first()
    assert (empty.n_runs, empty.longest, empty.median) == (0, 0, 0.0)


def test_value_kinds(spark):
    raw = ["", "NA", None, "12", "-3", "1.5", "1e3", "NaN", "inf", "SW"]
    got = {r.kind: r.cells for r in audit.value_kinds(spark.createDataFrame([(x,) for x in raw], "c string"), ["c"]).collect()}
    assert got == {"missing": 3, "int": 2, "float": 2, "nonfinite": 2, "text": 1}


def test_statistics(spark):
    rows = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 5.0), (1, 2.0, 7.0), (1, 4.0, 9.0), (2, 1.0, 1.0), (2, 1.0, 2.0), (2, 1.0, 3.0)], "g int, x double, y double")
    rho = {r.g: r.rho for r in stats.spearman(rows, "x", "y", ["g"]).collect()}
    assert rho[1] == pytest.approx(0.8333333333) and rho[2] is None
    fit = {r.g: r.slope for r in stats.least_squares(rows, "x", "y", ["g"]).collect()}
    assert fit[1] == pytest.approx(1.3684210526) and fit[2] is None
    bins = stats.histogram(spark.createDataFrame([(float(i),) for i in range(101)], "x double"), "x", 10, 1.0).orderBy("bin").collect()
    assert [r["count"] for r in bins] == [10] * 9 + [11]


def test_selection_and_interval(spark):
    scores = spark.createDataFrame([("a", 1.0, 2.0, 31), ("b", 1.0 + 1e-14, 2.0, 15), ("c", 1.1, 1.0, 15)], "id string, mae double, rmse double, leaves int").withColumn("h", F.lit(1))
    assert compare.selected(scores, ["h"], [F.col("leaves").asc()]).first().id == "b"
    seeds = spark.createDataFrame([(s, m, x) for s, d in enumerate([1.0, 2.0, 3.0, 4.0, 5.0]) for m, x in (("a", 10.0), ("b", 10.0 - d))], "seed int, model string, mae double").withColumn("h", F.lit(1))
    row = compare.paired_interval(seeds, "mae", "a", "b", ["h"]).first()
    assert row.mean_diff == -3.0 and row.high == pytest.approx(-3 + 2.7764451051977987 * 2.5**0.5 / 5**0.5) and row.same_direction


def test_haversine(spark):
    places = spark.createDataFrame([("x", 0.0, 0.0), ("y", 0.0, 90.0)], "place string, lat double, lon double")
    assert maps.distances(places).first().km == pytest.approx(6371.0088 * 3.141592653589793 / 2)
