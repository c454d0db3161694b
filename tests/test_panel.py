"""Literal cases of fills, gap age, scaling and windowed features."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import features, panel


def series(spark, values, station=0):
    rows = [(station, "v", i, None if x is None else float(x), x is not None) for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "station int, variable string, hour_idx int, value double, observed boolean")


def fill(spark, values, fallback, reach=6):
    medians = spark.createDataFrame([(0, "v", float(fallback))], "station int, variable string, train_median double")
    rows = panel.causal_fill(series(spark, values), medians, reach).orderBy("hour_idx").collect()
    return [r.filled for r in rows], [r.source for r in rows]


@pytest.mark.parametrize(
    ("values", "fallback", "filled", "source"),
    [
        ([10] + [None] * 6, -99, [10] * 7, [0] + [1] * 6),
        ([10] + [None] * 8, -99, [10] * 7 + [-99] * 2, [0] + [1] * 6 + [2] * 2),
        ([None, None, 5], -99, [-99, -99, 5], [2, 2, 0]),
        ([0, None, None, 30], -99, [0, 0, 0, 30], [0, 1, 1, 0]),
        ([None, None], 7.5, [7.5, 7.5], [2, 2]),
    ],
)
def test_causal_fill(spark, values, fallback, filled, source):
    assert fill(spark, values, fallback) == (filled, source)


def test_gap_age(spark):
    ages = lambda values, cap=168: [r.gap_age for r in panel.gap_age(series(spark, values), cap).orderBy("hour_idx").collect()]
    assert ages([1, None, None, 2]) == [0, 1, 2, 0]
    assert max(ages([1] + [None] * 199)) == 168 and set(ages([None] * 5)) == {168}


def test_categorical_fill(spark):
    rows = spark.createDataFrame([(0, i, 3 if i == 0 else None) for i in range(9)], "station int, hour_idx int, code int")
    got = panel.categorical_fill(rows, "code").orderBy("hour_idx").collect()
    assert [r.filled_code for r in got] == [3] * 7 + [16] * 2 and got[8].source == 2


def test_scaling(spark):
    cases = spark.createDataFrame([(5.0, 5.0, 2.0, 1.0), (3.0, 1.0, 0.0, 2.0), (3.0, 1.0, 0.0, 0.0)], "x double, m double, i double, s double")
    got = cases.select(scalars.robust_scale(F.col("x"), F.col("m"), F.col("i"), F.col("s")).alias("z"), scalars.scale_method(F.col("i"), F.col("s")).alias("k")).collect()
    assert [(r.z, r.k) for r in got] == [(0.0, "median_iqr"), (1.0, "median_std_zero_iqr_fallback"), (None, "constant")]


def test_trailing(spark):
    got = series(spark, [1, 2, 3, 4, 5, 6]).select("hour_idx", *features.trailing("value", (3,))).orderBy("hour_idx").collect()
    assert [r.value_mean3 for r in got] == [None, None, 2, 3, 4, 5] and got[2].value_std3 == pytest.approx((2 / 3) ** 0.5)
    got = series(spark, [5, 1, 9, 2]).select("hour_idx", *features.trailing("value", (3,))).orderBy("hour_idx").collect()
    assert [(r.value_min3, r.value_max3) for r in got][2:] == [(1, 9), (1, 9)]


def test_mask_fraction_and_context(spark):
    rows = series(spark, [1, None, 3, 4])
    assert rows.select("hour_idx", *features.mask_fractions("observed", (4,))).orderBy("hour_idx").collect()[3].observed_share4 == 0.75
    steps = rows.select("hour_idx", features.context(["value"], 3).alias("s")).orderBy("hour_idx").collect()
    assert steps[1].s is None and [x.value for x in steps[3].s] == [None, 3, 4]


def test_what_comes_later_changes_nothing(spark):
    values = [float(i * 7 % 11) if i % 3 else None for i in range(80)]
    late = values[:60] + [9999.0] * 20
    made = lambda v: panel.causal_fill(series(spark, v), spark.createDataFrame([(0, "v", 4.0)], "station int, variable string, train_median double"))
    look = lambda v: made(v).select("hour_idx", "filled", *features.lags("filled"), *features.trailing("filled")).filter("hour_idx < 60").orderBy("hour_idx").collect()
    assert look(values) == look(late)


def test_grid_keeps_missing_hours(spark):
    rows = spark.createDataFrame([(0, "v", 1, 5.0), (1, "v", 0, 2.0)], "station int, variable string, hour_idx int, value double")
    got = panel.grid(rows, 3)
    assert got.count() == 6 and got.filter("observed").count() == 2


def test_feature_names():
    assert len(features.feature_names("R0", "t", [])) == 6 and len(features.feature_names("R1", "t", [])) == 34
    assert len(features.feature_names("R2", "t", ["a", "b"])) == 90
