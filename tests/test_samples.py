"""Samples, guards, baselines."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import baselines, samples
from gridloom.sources.tables import Timeline

TIME = Timeline("2024-01-01 00:00:00", 120, 59, 89)


@pytest.fixture
def target(spark):
    rows = [(0, i, float(i), i % 10 != 0) for i in range(120)]
    return spark.createDataFrame(rows, "station int, hour_idx int, value double, observed boolean").withColumn("value", F.when(F.col("observed"), F.col("value")))


def test_eligibility_and_ids(target):
    rows = samples.candidates(target, TIME, (1, 24), 48)
    got = {(r.horizon, r.target_idx): r for r in rows.collect()}
    assert got[1, 47].reason == "insufficient_history" and got[1, 48].reason == "eligible" and got[1, 50].reason == "target_missing"
    assert got[24, 95].context_start == 24 and got[24, 95].sample_id == "test|0|2024010423|h24"
    counts = samples.sample_counts(rows, [["partition", "station", "horizon"], ["horizon"]]).filter("station is null").collect()
    assert all(r.candidates == r.insufficient_history + r.target_missing + r.eligible == 120 for r in counts)
    bad = samples.window_invariants(samples.eligible(rows), 48).first()
    assert bad.samples > 0 and not any((bad.bad_length, bad.bad_origin, bad.not_before_target, bad.before_start))


def test_ids_are_read_back(spark):
    ids = spark.createDataFrame([("test|s1|2024010423|h24",)], "id string")
    parts = scalars.parse_sample_id(F.col("id"))
    row = ids.select(*[c.alias(k) for k, c in parts.items()]).first()
    assert (row.partition, row.station, row.horizon, row.target.hour) == ("test", "s1", 24, 23)
    with pytest.raises(Exception, match="malformed"):
        spark.createDataFrame([("nonsense",)], "id string").select(scalars.parse_sample_id(F.col("id"))["station"]).collect()


def test_asof_and_guards(spark, target):
    got = {r.hour_idx: r for r in samples.asof_latest(target, 2).collect()}
    assert (got[10].asof_value, got[10].asof_age) == (9.0, 1) and got[0].asof_value is None
    rows = samples.eligible(samples.candidates(target, TIME, (6,), 48))
    looked = samples.guarded_lookup(rows, target, F.col("target_idx") - 3, 89)
    assert looked.filter("looked_up is not null").count() == 0 and looked.filter("refused").count() == rows.count()
    open_ = samples.guarded_lookup(rows, target, F.col("target_idx") - 6, 80).collect()
    assert all(r.looked_up is None or r.target_idx - 6 <= 80 for r in open_)
    assert samples.violations(rows, F.col("origin_idx") + 1, F.lit(500)).first().after_origin == rows.count()


def test_baselines(spark, target):
    filled = target.withColumn("filled", F.coalesce("value", F.lit(-1.0))).withColumn("source", F.lit(0))
    rows = samples.eligible(samples.candidates(target, TIME, (1, 24), 48)).withColumn("month", F.lit(1)).withColumn("hour", (F.col("target_idx") % 24).cast("int"))
    rows = baselines.seasonal(baselines.persistence(rows, filled), target)
    got = rows.collect()
    assert all(r.b0 == (r.origin_idx if r.origin_idx % 10 else -1.0) for r in got)
    assert all(r.b1 == (r.target_idx - 24 if r.b1_direct else r.b0) for r in got) and all(r.b1 == r.b0 for r in got if r.horizon == 24)
    table = baselines.climatology(spark.createDataFrame([(0, 1, 0, 4.0), (0, 1, 0, 6.0), (0, 2, 5, 9.0)], "station int, month int, hour int, value double"))
    asked = spark.createDataFrame([(0, 1, 0), (0, 1, 5), (0, 1, 7), (9, 1, 1)], "station int, month int, hour int")
    levels = {(r.station, r.hour): (r.b2, r.b2_level) for r in baselines.climatological(asked, table).collect()}
    assert levels == {(0, 0): (5.0, 0), (0, 5): (9.0, 1), (0, 7): (6.0, 2), (9, 1): (None, None)}


def test_groups_go_there_and_back(spark):
    rows = spark.createDataFrame([(0, 5, 1, 1.0), (1, 5, 1, 2.0), (1, 6, 1, 3.0)], "station int, target_idx int, horizon int, actual double")
    groups = samples.grouped(rows, [0, 1])
    back = samples.scattered(groups, [0, 1]).collect()
    assert groups.count() == 2 and sorted((r.station, r.target_idx, r.prediction) for r in back) == [(0, 5, 1.0), (1, 5, 2.0), (1, 6, 3.0)]
    assert samples.withheld(rows, 1).filter("actual is null").count() == 2


def test_predictions_must_fit(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    good = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "sample_id string, prediction double")
    assert samples.scored_once(good, ids).count() == 2
    for bad in ([("a", 1.0)], [("a", 1.0), ("b", float("nan"))], [("a", 1.0), ("b", 1.0), ("c", 1.0)], [("a", 1.0), ("a", 1.0), ("b", 1.0)]):
        with pytest.raises(ValueError, match="match"):
            samples.scored_once(spark.createDataFrame(bad, "sample_id string, prediction double"), ids)
