"""Nearest places against brute force, with poles, the date line, clusters and far ones; events in blocks of hours."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import events
from gridloom.operators import places as maps


def km(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


def world(seed):
    rng = random.Random(seed)
    out = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)]
    out += [(100 + i, 48 + rng.gauss(0, 0.01), 2 + rng.gauss(0, 0.01)) for i in range(60)]
    return out + [(200, 90.0, 0.0), (201, 89.9, 170.0), (202, 0.0, 179.99), (203, 0.0, -179.99), (204, 10.0, 10.0), (205, 10.0, 10.0), (206, 10.0, 10.0), (207, -90.0, 5.0)]


@pytest.mark.parametrize(("k", "side"), [(1, None), (3, None), (3, 0.01), (5, 3.0)])
def test_nearest_against_brute_force(spark, k, side):
    places = world(k)
    df = spark.createDataFrame([*places, (None, 1.0, 1.0), (999, None, 2.0)], "place long, lat double, lon double").withColumn("km", F.lit("clash"))
    got = {(r.place, r.rank): (r.neighbour, r.km) for r in maps.nearest(df, k, side).collect()}
    assert len(got) == k * len(places)
    for a in places:
        for rank, (d, b) in enumerate(sorted((round(km(a, b), 9), b[0]) for b in places if b[0] != a[0])[:k], 1):
            found = got[a[0], rank]
            assert found[1] == pytest.approx(d, abs=1e-6) and (found[0] == b or km(a, next(p for p in places if p[0] == found[0])) == pytest.approx(d, abs=1e-6))


def test_few_places_and_no_nested_loops(spark):
    two = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0)], "place long, lat double, lon double")
    assert sorted((r.place, r.rank, r.neighbour) for r in maps.nearest(two, 3).collect()) == [(1, 1, 2), (2, 1, 1)]
    assert maps.nearest(two.limit(0), 3).count() == 0 and maps.nearest(two.limit(1), 3).count() == 0
    plan = maps.nearest(two, 3)._jdf.queryExecution().toString()
    edges = maps.edge_distances(spark.createDataFrame([(1, 2, 1.0), (1, 1, 2.0)], "source long, target long, weight double"), two)
    assert edges.count() == 1 and edges.first().km == pytest.approx(km((1, 0.0, 0.0), (2, 5.0, 5.0)))
    for text in (plan, edges._jdf.queryExecution().toString()):
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_tables_of_all_distances_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(maps, "MOST_PLACES", 3)
    with pytest.raises(ValueError, match="3 places"):
        maps.distances(spark.createDataFrame(world(1), "place long, lat double, lon double"))


@pytest.mark.parametrize("block", [1, 7, 48, 10_000])
def test_events_meet_errors_once_whatever_the_block(spark, monkeypatch, block):
    monkeypatch.setattr(events, "BLOCK", block)
    found = spark.createDataFrame([(1, 1, 0, 5, 3), (1, 2, 40, 160, 90), (2, 1, 47, 48, 48)], "station int, event int, start int, end int, peak_hour int")
    errors = spark.range(200).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("station"), F.col("id").cast("int").alias("target_idx"), F.lit("m").alias("model"), F.lit(6).alias("horizon"), F.lit(3.0).alias("prediction"), F.lit(-1.0).alias("residual"))
    made = events.event_metrics(found, errors, 2.0)
    assert sorted((r.station, r.event, r.n, r.prediction_at_peak) for r in made.collect()) == [(1, 1, 6, 3.0), (1, 2, 121, 3.0), (2, 1, 2, 3.0)]
    assert "_block" in made._jdf.queryExecution().optimizedPlan().toString()
