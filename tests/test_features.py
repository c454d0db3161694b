"""Neighbour columns, rain means, sequences and static channels against plain loops."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import features, places, samples
from gridloom.plans import base, panel_queries

SF = "/root/testdata/sf0.001"
#: The variables and categories of the hourly air-quality panel that the channel lists are made for.
WEATHER, POLLUTANTS = ["TEMP", "PRES", "DEWP", "RAIN", "WSPM"], ["PM2.5", "PM10", "SO2", "NO2", "CO", "O3"]


def test_channel_lists_have_their_order():
    codes = [str(k) for k in range(16)] + ["MISSING"]
    first, second = features.dynamic_names(["PM2.5", *WEATHER], ["PM2.5"], "RAIN", codes), features.dynamic_names([*POLLUTANTS, *WEATHER], POLLUTANTS, "RAIN", codes)
    assert (len(features.dynamic_names(WEATHER, [], "RAIN", codes)), len(first), len(second)) == (28, 31, 46)
    assert first[:2] == ["value:PM2.5", "value:TEMP"] and first[6] == "mask:PM2.5" and first[12:15] == ["gap_age_scaled:PM2.5", "RAIN_occurred", "wd_is_0"]
    static = features.static_names([f"s{i}" for i in range(12)], samples.HORIZONS)
    assert len(static) == 28 and static[11:17] == ["station_is_s11", "horizon_is_1h", "horizon_is_6h", "horizon_is_12h", "horizon_is_24h", "origin_hour_sin"] and static[-1] == "target_month_cos"


@pytest.fixture(scope="module")
def wide(spark):
    return panel_queries.wide_panel(spark, SF)


def test_neighbours_and_rain_at_the_origin(spark, wide):
    near = places.nearest(panel_queries.station_places(spark), 3)
    order = {(r.place, r.rank): r.neighbour for r in near.collect()}
    chosen = samples.eligible(base.candidates(spark, SF)).filter("horizon = 6")
    made = features.sample_matrix(wide, chosen, "R3", base.TARGET, panel_queries.OTHERS, base.STATIONS, 17, base.TIME.start, panel_queries.RAIN, near, 3).orderBy("station", "target_idx").collect()
    cells = {(r.station, r.hour_idx): r for r in wide.collect()}
    assert len(made) == chosen.count()
    for r in made:
        for rank in (1, 2, 3):
            other = order[r.station, rank]
            assert [r[f"near{rank}_{base.TARGET}_lag{k}"] for k in features.LAGS] == [cells[other, r.origin_idx - k][base.TARGET] for k in features.LAGS]
            assert (r[f"near{rank}_observed_lag0"], r[f"near{rank}_gap_age"]) == (cells[other, r.origin_idx][f"{base.TARGET}_observed"], cells[other, r.origin_idx][f"{base.TARGET}_gap_age"])
        for n in features.SPANS:
            assert r[f"{panel_queries.RAIN}_occurred_mean{n}"] == pytest.approx(sum(cells[r.station, r.origin_idx - k][f"{panel_queries.RAIN}_occurred"] for k in range(n)) / n)
    few = features.neighbour_columns(wide, near.filter("rank = 1"), base.TARGET, 3).first()
    assert few[f"near1_{base.TARGET}_lag0"] is not None and few[f"near3_{base.TARGET}_lag0"] is None
    plan = features.neighbour_columns(wide, near, base.TARGET, 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tensors_hold_the_context(spark, wide):
    numeric, aged = panel_queries.SEQUENCES["R2"]
    chosen = samples.eligible(base.candidates(spark, SF)).select("sample_id", "station", "horizon", "target_idx", "origin_idx")
    static = features.static_vector(list(range(base.STATIONS)), samples.HORIZONS, base.TIME.start)
    rows = features.tensors(wide, chosen, features.dynamic_vector(numeric, aged, panel_queries.RAIN, 17), static).orderBy("sample_id").limit(40).collect()
    assert features.tensors(wide, chosen, features.dynamic_vector(numeric, aged, panel_queries.RAIN, 17), static).count() == chosen.count()
    cells = {(r.station, r.hour_idx): r for r in wide.collect()}
    names = features.dynamic_names(numeric, aged, panel_queries.RAIN, [str(k) for k in range(17)])
    for r in rows:
        assert r["shape"] == [48, len(names)] and len(r.dynamic) == 48 * len(names) and len(r.static) == len(features.static_names([*range(base.STATIONS)], samples.HORIZONS))
        for step in (0, 17, 47):
            cell = cells[r.station, r.origin_idx - 47 + step]
            want = [cell[f"{x}_scaled"] for x in numeric] + [float(cell[f"{x}_observed"]) for x in numeric] + [cell[f"{x}_gap_age"] / 168 for x in aged] + [cell[f"{panel_queries.RAIN}_occurred"]] + [float(cell.code == k) for k in range(17)]
            assert r.dynamic[step * len(names) : (step + 1) * len(names)] == pytest.approx(want, rel=1e-6)
        assert r.static[: base.STATIONS] == [float(r.station == s) for s in range(base.STATIONS)] and r.static[base.STATIONS : base.STATIONS + 4] == [float(r.horizon == h) for h in samples.HORIZONS]


def test_contexts_that_are_not_whole_go(spark):
    wide = spark.createDataFrame([(1, h, float(h)) for h in range(5)], "station int, hour_idx int, x double")
    asked = spark.createDataFrame([(1, h) for h in range(6)], "station int, origin_idx int")
    got = features.tensors(wide, asked, F.array(F.col("x").cast("float")), F.array(F.lit(1.0)), 3)
    assert sorted((r.origin_idx, r.dynamic) for r in got.collect()) == [(2, [0, 1, 2]), (3, [1, 2, 3]), (4, [2, 3, 4])]
    assert [r.c for r in got.select(features.checksum("dynamic").alias("c")).collect() if r.c] != []


def test_regimes_from_one_matrix_equal_their_own(spark, wide):
    near = places.nearest(panel_queries.station_places(spark), 3)
    chosen = samples.eligible(base.candidates(spark, SF)).filter("horizon = 24")
    fixed = (base.TARGET, panel_queries.OTHERS, base.STATIONS, 17, base.TIME.start, panel_queries.RAIN, near, 3)
    names = {r: features.sample_names(r, base.TARGET, panel_queries.OTHERS, base.STATIONS, 17, panel_queries.RAIN, 3) for r in features.REGIMES}
    every = features.by_regime(features.sample_matrix(wide, chosen, "R3", *fixed), names)
    keys = ["station", "horizon", "target_idx", "origin_idx"]
    for regime, columns in names.items():
        mine = every.filter(F.col("regime") == regime)
        own = features.sample_matrix(wide, chosen, regime, *fixed)
        assert sorted(map(tuple, mine.select(*keys, *columns).collect()), key=lambda r: r[:4]) == sorted(map(tuple, own.select(*keys, *columns).collect()), key=lambda r: r[:4])
        lacking = [c for c in names["R3"] if c not in columns]
        assert not lacking or mine.filter(F.coalesce(*[F.col(c).cast("string") for c in lacking]).isNotNull()).isEmpty()
    with pytest.raises(ValueError, match="lacks columns"):
        features.by_regime(wide, {"one": ["a"], "two": ["b"]})
