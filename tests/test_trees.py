"""Tree grids: splits and selection against plain loops, gains, and fits that don't depend on partitions."""

import json
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import compare, governance, trees

REGIMES = {"R0": [0, 1], "R1": [0, 1, 2]}
GRID = trees.candidates()


def plain_split(bins, signs, least):
    """(gain, feature, bin) by trying every split."""
    best = None
    for j, b in product(range(bins.shape[1]), range(trees.BINS)):
        left = bins[:, j] <= b
        if left.sum() >= least and (~left).sum() >= least:
            gain = signs[left].sum() ** 2 / left.sum() + signs[~left].sum() ** 2 / (~left).sum() - signs.sum() ** 2 / len(signs)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                best = (gain, j, b)
    return best


@pytest.mark.parametrize("seed", range(5))
def test_splits_against_plain_loops(seed):
    rng = np.random.default_rng(seed)
    bins, signs = rng.integers(0, 6, (60, 4)).astype(np.uint8), rng.integers(-1, 2, 60).astype(float)
    found, want = trees.best_split(bins, signs, 7), plain_split(bins, signs, 7)
    assert found[1:] == want[1:] and found[0] == pytest.approx(want[0])
    assert trees.best_split(np.zeros((9, 2), np.uint8), np.ones(9), 1) is None


def test_trees_learn_and_keep_their_bounds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5))
    y = np.where(x[:, 2] > 0.3, 10.0, 1.0) + 2 * (x[:, 4] > 0) + rng.normal(size=800) * 0.1
    for c in GRID:
        model, gains = trees.fitted(x, y, c, 12)
        guess = trees.guessed(json.loads(json.dumps(model)), x)
        assert np.abs(y - guess).mean() < 0.6 * np.abs(y - np.median(y)).mean() and gains.argmax() == 2
        assert all(sum(f < 0 for f in t["feature"]) <= c["leaves"] for t in model["trees"])
    odd = np.array([[np.nan, 1.0], [np.nan, 2.0]] * 40)
    model, gains = trees.fitted(odd, np.arange(80.0), GRID[0], 3)
    assert np.isfinite(trees.guessed(model, odd)).all() and gains[0] == 0


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = []
    for i in range(600):
        x = [rng.gauss(0, 1) for _ in range(3)]
        made.append((f"s{i:04d}", i % 3, (1, 6)[i % 2], "train" if i < 400 else "validation", 5 * (x[0] > 0) + 3 * x[2] + rng.gauss(0, 0.1), x))
    return spark.createDataFrame(made, "sample_id string, station int, horizon int, partition string, actual double, features array<float>").cache()


def test_scores_and_selection_against_plain_rules(rows):
    models = trees.fit_grid(rows.filter("partition = 'train'"), REGIMES, GRID).cache()
    assert models.count() == 2 * 2 * 8 and {r.rows for r in models.collect()} == {200}
    found = trees.predicted(rows.filter("partition = 'validation'"), models, REGIMES, ["sample_id", "station", "horizon", "actual"]).cache()
    assert found.count() == 200 * 2 * 8
    scores = trees.candidate_scores(found, GRID).cache()
    by = {}
    for r in found.collect():
        by.setdefault((r.regime, r.horizon, r.candidate, r.station), []).append(r.actual - r.prediction)
    plain = {}
    for (regime, horizon, candidate, _), e in by.items():
        plain.setdefault((regime, horizon, candidate), []).append((np.mean(np.abs(e)), np.sqrt(np.mean(np.square(e)))))
    plain = {k: tuple(np.mean(v, axis=0)) for k, v in plain.items()}
    for r in scores.collect():
        assert (r.mae, r.rmse) == pytest.approx(plain[r.regime, r.horizon, r.candidate])
    told = {c["candidate"]: c for c in GRID}
    rule = lambda s, c: (round(s[0] / 1e-12), round(s[1] / 1e-12), told[c]["leaves"], -told[c]["least_rows"], c)
    best = {(r.regime, r.horizon): r.candidate for r in compare.selected(scores, ["regime", "horizon"], trees.ties()).collect()}
    assert best == {(g, h): min(told, key=lambda c: rule(plain[g, h, c], c)) for g in REGIMES for h in (1, 6)}
    means = {(h, c): np.mean([plain[g, h, c] for g in REGIMES], axis=0) for h in (1, 6) for c in told}
    overall = compare.selected(trees.mean_over_regimes(scores), ["horizon"], trees.ties()).collect()
    assert {r.horizon: r.candidate for r in overall} == {h: min(told, key=lambda c: rule(means[h, c], c)) for h in (1, 6)} and {r.regimes for r in overall} == {2}


def test_equal_scores_go_to_the_smaller_capacity(spark):
    rows = [("R0", 1, c["candidate"], 10, 1.0 + (1e-14 if c["leaves"] == 4 else 0), 2.0, c["learning_rate"], c["leaves"], c["least_rows"]) for c in GRID]
    scores = spark.createDataFrame(rows, "regime string, horizon int, candidate string, n int, mae double, rmse double, learning_rate double, leaves int, least_rows int")
    row = compare.selected(scores, ["regime", "horizon"], trees.ties()).first()
    assert (row.leaves, row.least_rows, row.candidate) == (4, 60, "C02")


def test_gains_belong_to_names_and_add_up(rows):
    models = trees.fit_grid(rows.filter("partition = 'train'"), REGIMES, GRID[:2])
    shares = trees.gain_shares(models, ["a", "b", "c"], REGIMES).cache()
    sums = shares.groupBy("regime", "horizon", "candidate").agg(F.sum("share").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.s == pytest.approx(1) for r in sums) and {(r.regime, r.n) for r in sums} == {("R0", 2), ("R1", 3)}
    assert {r.feature for r in shares.filter("regime = 'R1' and place = 1").collect()} <= {"a", "c"} and {r.feature for r in shares.filter("regime = 'R0' and place = 1").collect()} == {"a"}


def test_fits_don_t_depend_on_partitions_and_bounds(rows):
    train = rows.filter("partition = 'train'")
    first = trees.fit_digests(trees.fit_grid(train, REGIMES, GRID[:2], most=50))
    other = trees.fit_digests(trees.fit_grid(train.orderBy(F.desc("actual")).repartition(5), REGIMES, GRID[:2], most=50))
    assert {r.status for r in governance.drift(first, other).collect()} == {"same"}
    assert {r.rows for r in trees.fit_grid(train, REGIMES, GRID[:1], most=50).collect()} == {50}
    changed = train.withColumn("actual", F.when(F.col("sample_id") == trees_first(train), 1e6).otherwise(F.col("actual")))
    assert "changed" in {r.status for r in governance.drift(first, trees.fit_digests(trees.fit_grid(changed, REGIMES, GRID[:2], most=50))).collect()}
    assert trees.fit_grid(train.limit(0), REGIMES, GRID).count() == 0


def trees_first(train):
    """The sample that every fit of its horizon learns from first."""
    return train.orderBy(F.shiftrightunsigned(F.xxhash64("sample_id"), 11)).first().sample_id
