"""Ranks and quantiles of pooled columns against pandas, with outliers, heavy tails, ties, infinities, NaN and nulls."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import stats


def values(kind, n):
    rng = random.Random(kind)
    draw = {"outlier": lambda: rng.random(), "tail": lambda: rng.paretovariate(0.3), "ties": lambda: float(rng.randint(0, 5)), "negative": lambda: -(10 ** rng.uniform(-9, 9))}[kind]
    return [draw() for _ in range(n)] + [1e9] * (kind == "outlier")


@pytest.mark.parametrize("kind", ["outlier", "tail", "negative"])
def test_no_range_holds_many_values(spark, kind):
    counted = spark.createDataFrame([(v, 1) for v in values(kind, 20_000)], "x double, n long")
    sizes = [r["count"] for r in stats.ranged(counted, "x", [], 400).groupBy("_range").count().collect()]
    assert sum(sizes) >= 20_000 and max(sizes) <= 0.01 * sum(sizes)


@pytest.mark.parametrize("most", [50_000, 100])
@pytest.mark.parametrize("kind", ["outlier", "tail", "ties"])
def test_ranks_and_quantiles(spark, monkeypatch, kind, most):
    monkeypatch.setattr(stats, "BUCKET_VALUES", most)
    xs = values(kind, 3000)
    rows = pd.DataFrame({"g": [("a", "b", None)[i % 3] for i in range(len(xs))], "x": xs, "y": [x * (i % 11) for i, x in enumerate(xs)]})
    df = spark.createDataFrame([tuple(r) for r in rows.itertuples(index=False)], "g string, x double, y double")
    got = stats.ranked(df, {"x": "rx", "y": "ry"}, ["g"]).toPandas().sort_values(["x", "y"]).reset_index(drop=True)
    for name in ("x", "y"):
        want = got.groupby("g", dropna=False)[name].rank()
        assert (got[f"r{name}"] == want).all()
    shares = {"low": 0.0625, "mid": 0.5, "high": 0.984375}
    for r in stats.quantiles(df, "x", ["g"], shares).collect():
        own = rows[rows.g.isna() if r.g is None else rows.g == r.g].x
        assert [r[name] for name in shares] == pytest.approx([own.quantile(p) for p in shares.values()], rel=1e-9)
    assert stats.quantiles(df, "x", [], {"m": 0.5}).first().m == pytest.approx(rows.x.quantile(0.5), rel=1e-12)


@pytest.mark.parametrize("most", [50_000, 1])
def test_odd_values_have_their_places(spark, monkeypatch, most):
    monkeypatch.setattr(stats, "BUCKET_VALUES", most)
    df = spark.createDataFrame([(v,) for v in (None, None, -math.inf, 1.0, 1.0, 2.0, math.inf, math.nan, math.nan)], "x double")
    got = {str(r.x): (r.n, r.before, r["rows"]) for r in stats.running_counts(df, "x", []).collect()}
    assert got == {"None": (2, 0, 9), "-inf": (1, 2, 9), "1.0": (2, 3, 9), "2.0": (1, 5, 9), "inf": (1, 6, 9), "nan": (2, 7, 9)}
    assert stats.running_counts(df.limit(0), "x", []).count() == 0
    assert stats.running_counts(df.withColumn("k", F.lit(None).cast("int")), "x", ["k"]).agg(F.sum("n")).first()[0] == 9


def test_positions_in_order(spark):
    from gridloom.operators import contracts

    rows = spark.createDataFrame([(g, i * 7 % 101, "x") for g in ("b", None, "a") for i in range(101)], "g string, i int, _here string").repartition(5)
    got = contracts.numbered(rows.drop("_here"), ["g"], ["i"]).collect()
    assert [(r.g, r.i) for r in sorted(got, key=lambda r: r.position)] == [(g, i) for g in (None, "a", "b") for i in range(101)] and {r.position for r in got} == set(range(303))
    assert contracts.numbered(rows.limit(0), ["g"], ["i"]).count() == 0


def test_pairs_of_stations_are_bounded(spark, monkeypatch):
    from gridloom.operators import features

    rows = spark.range(40).select((F.col("id") % 4).cast("int").alias("station"), F.floor(F.col("id") / 4).cast("int").alias("hour_idx"), F.col("id").cast("double").alias("value"))
    assert stats.station_correlation(rows).count() == 16 and features.neighbour_context(rows, ["value"], 3).count() == 32
    with pytest.raises(ValueError, match="pairs of all stations"):
        stats.few_stations(rows, 3)


def test_linear_models_learn_from_all_rows(spark):
    import numpy as np

    from gridloom.operators import models

    rng = np.random.default_rng(2)
    steps, true = rng.normal(size=(300, 5)), np.array([1.0, -2.0, 0.5, 0.0, 3.0, 7.0])
    made = spark.createDataFrame([(1, i, row.tolist(), float(row @ true[:-1] + true[-1])) for i, row in enumerate(steps)], "station int, hour_idx int, steps array<double>, ahead double").repartition(4)
    weights = models.linear_fit(made, "ahead", ridge=1e-9)
    assert weights == pytest.approx(true, abs=1e-6)
    got = {r.hour_idx: r.prediction for r in models.infer(made, models.linear(weights)).collect()}
    assert all(got[r.hour_idx] == pytest.approx(r.ahead, abs=1e-5) for r in made.collect())
    with pytest.raises(ValueError, match="no rows"):
        models.linear_fit(made.limit(0), "ahead")


def test_keys_of_json(spark):
    from gridloom.operators import audit

    rows = spark.createDataFrame([("a", '{"k": 1}'), ("a", '{"k": 1, "l": 2}'), ("a", "{"), ("a", None), ("b", "[1]")], "kind string, props string")
    assert sorted(map(tuple, audit.json_matches(rows, "props", ["k"], ["kind"]).collect())) == [("a", 4, 1, 2), ("b", 1, 0, 1)]


def test_pooled_scaling_quantiles_match_pandas(spark, monkeypatch):
    from gridloom.operators import panel

    monkeypatch.setattr(stats, "BUCKET_VALUES", 40)  # so that a variable lies in several ranges
    rng = random.Random(3)
    rows = [(v, s, h, None if rng.random() < 0.2 else float("nan") if rng.random() < 0.05 else rng.paretovariate(0.5)) for v in "ab" for s in range(3) for h in range(60)]
    rows += [("c", 0, h, None) for h in range(5)]  # never observed
    grid = spark.createDataFrame(rows, "variable string, station int, hour_idx int, value double")
    got = {(r.variable, r.station): r for r in panel.scaling_statistics(grid, 39).collect()}
    assert set(got) == {(v, s) for v in "ab" for s in (None, 0, 1, 2)}
    for (v, s), r in got.items():
        seen = [x for w, t, h, x in rows if w == v and s in (None, t) and h <= 39 and x is not None]
        real = pd.Series([x for x in seen if not math.isnan(x)])
        assert r.n == len(seen)
        assert (r.median, r.p25, r.p75, r.iqr) == pytest.approx((real.median(), real.quantile(0.25), real.quantile(0.75), real.quantile(0.75) - real.quantile(0.25)))
    assert panel.scaling_statistics(grid.limit(0), 39).count() == 0


def test_spread_of_groups(spark):
    rows = [("a", float(x)) for x in (1, 2, 4, 8)] + [("b", 5.0), ("b", None), ("c", None)]
    got = {r.k: r for r in stats.spread(spark.createDataFrame(rows, "k string, x double"), "x", ["k"]).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.n, a.mean, a.median, a.min, a.max, a.q25, a.q75, a.iqr) == (4, 3.75, 3.0, 1.0, 8.0, 1.75, 5.0, 3.25)
    assert (b.n, b.median, b.iqr) == (1, 5.0, 0.0) and (c.n, c.median, c.mean) == (0, None, None)
