"""The panel of all users and its baselines from observations alone, against the joined operators over dense rows."""

import math
import re

import pytest
from pyspark.sql import functions as F

from gridloom.operators import baselines, features, panel, samples
from gridloom.plans import user_queries
from gridloom.sources.tables import Timeline

TIME = Timeline("2024-01-01 00:00:00", 240, 119, 179)


@pytest.fixture(scope="module")
def seen(spark):
    """Stations with gaps below and above the reach, one without training values, one with a null value, one without any."""
    rows = [(s, i, float((i * 37 + s * 11) % 101) / 2) for s in (1, 2) for i in range(240) if (i * (s + 2)) % 8 < 2 and not 60 <= i < 60 + 9 * s]
    rows += [(3, i, float(i)) for i in range(150, 240, 5)] + [(4, 0, 1.0), (4, 2, None), (4, 239, 5.0), (5, 7, None), (None, 3, 2.0)]
    return spark.createDataFrame(rows, "station long, hour_idx int, value double")


def dense(seen):
    grid = panel.grid(seen, TIME.hours, ("station",))
    return panel.causal_fill(grid, panel.train_medians(grid, TIME.train_end, ("station",)), keys=("station",))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filled_series_is_the_joined_fill(spark, seen):
    columns = ["station", "hour_idx", "value", "observed", "filled", "source"]
    made = panel.filled_series(seen, TIME.hours, TIME.train_end, 3, keys=("station",)).select(*columns)
    plan = plan_of(made)
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert sorted(made.collect(), key=str) == sorted(dense(seen).select(*columns).collect(), key=str) and made.count() == 5 * 240


def test_baselines_of_observations_are_the_joined_ones(spark, seen):
    filled = dense(seen)
    clock = [F.lit(1).alias("month"), (F.col("hour_idx") % 24).alias("hour")]
    rows = samples.eligible(samples.candidates(filled, TIME)).withColumn("month", F.lit(1)).withColumn("hour", F.col("target_idx") % 24)
    rows = rows.join(filled.select("station", F.col("hour_idx").alias("target_idx"), F.col("value").alias("actual")), ["station", "target_idx"])
    rows = baselines.seasonal(baselines.persistence(rows, filled), filled)
    train = filled.filter((F.col("hour_idx") <= TIME.train_end) & F.col("value").isNotNull()).select("station", *clock, "value")
    columns = ["sample_id", "partition", "station", "horizon", "target_idx", "origin_idx", "actual", "b0", "b1", "b2"]
    want = baselines.climatological(rows, baselines.climatology(train)).select(*columns).orderBy("sample_id").collect()
    made = baselines.of_observations(seen, TIME, clock).select(*columns)
    assert made.orderBy("sample_id").collect() == want and len(want) > 300 and any(r.b2 is None for r in want) and any(r.b1 != r.b0 for r in want)


def test_user_baselines_broadcast_and_join_nothing(spark, sf):
    plan = plan_of(user_queries.user_baselines(spark, sf))
    assert "Broadcast" not in plan and "Join" not in plan and "Generate explode(sequence" not in plan


def test_user_events_make_no_dense_hours(spark, sf):
    plan = plan_of(user_queries.user_events(spark, sf))
    assert "Broadcast" not in plan and "Join" not in plan and "Generate" not in plan


def test_user_event_metrics_broadcast_nothing(spark, sf):
    plan = plan_of(user_queries.user_event_metrics(spark, sf))
    assert "Broadcast" not in plan and plan.count("Join") == 1


def test_actuals_are_not_broadcast_by_the_size_of_their_files(spark, seen, tmp_path):
    from gridloom.sources import stored

    stored.store_panel(panel.filled_series(seen, TIME.hours, TIME.train_end, 2, keys=("station",)), str(tmp_path / "p"), TIME)
    made = baselines.of_observations(seen, TIME, [F.lit(1).alias("month"), F.lit(0).alias("hour")]).filter("partition = 'test'").withColumn("prediction", F.col("b0")).drop("actual", "partition")
    scored = stored.actuals(spark, str(tmp_path / "p"), "test", made)
    assert "Broadcast" not in plan_of(scored)
    assert scored.filter("actual is null").count() == 0 and scored.count() == made.count() > 0


def test_locked_predictions_join_nothing(spark, seen):
    from gridloom.plans import stored_queries

    plan = plan_of(stored_queries.persistence(TIME, seen, "test"))
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("Exchange") == 1


def test_windows_know_the_hours_that_samples_start_from(spark, seen):
    from gridloom.plans import stored_queries

    filled = panel.filled_series(seen, TIME.hours, TIME.train_end, 2, keys=("station",))
    index = samples.eligible(samples.candidates(filled, TIME))
    made = stored_queries.windowed(filled).filter("origin").select("station", F.col("hour_idx").alias("origin_idx"))
    starts = {tuple(r) for r in index.select("station", "origin_idx").collect()}
    assert starts <= {tuple(r) for r in made.collect()} and made.count() < filled.count()


def test_rolled_is_trailing_and_mask_fractions(spark, seen):
    rows = dense(seen).withColumn("filled", F.when(~((F.col("station") == 1) & F.col("hour_idx").isin(90, 91)), F.col("filled") * 100 + 1e9))
    spans = features.SPANS
    want = rows.select("station", "hour_idx", *features.trailing("filled"), *features.mask_fractions("observed", spans))
    made = features.rolled(rows.select("station", "hour_idx", "filled", "observed"), "filled", "observed").select(*want.columns)
    got, expected = ([list(r) for r in df.orderBy("station", "hour_idx").collect()] for df in (made, want))
    far = [(g, e) for g, e in zip(sum(got, []), sum(expected, []), strict=True) if g != e and (None in (g, e) or not math.isclose(g, e, rel_tol=1e-6))]
    assert len(got) == 5 * 240 and not far
    assert made.filter("filled_max48 is null").count() == 5 * 47 + 49  # a null takes the spans that hold it, and no other
    with pytest.raises(ValueError, match="no multiple"):
        features.rolled(rows, "filled", "observed", (3, 4))


def test_user_feature_digests_visit_no_hour_twice(spark, sf):
    plan = plan_of(user_queries.user_feature_digests(spark, sf))
    assert "stddev_pop" not in plan and "avg(" not in plan and "lag(" in plan
    assert all(first == last for first, last in re.findall(r"RowFrame, (-\d+), (\S+?)\)", plan))
