"""Grids of boosted trees: many fits as one job, scored over all rows in another, with gains and digests.

Each fit, a candidate in a regime at a horizon, learns from the same bounded sample of training rows: the `FIT_ROWS` rows
of a horizon whose ids have the smallest hashes. A group of one fit is therefore small however many rows there are, and
the groups spread over tasks. Scoring, metrics and selection take every row: models are small and go to the tasks as a
broadcast, and one pass gives the predictions of all fits of a row's horizon.

Trees are grown best-first on bins of quantiles, on the signs of residuals, and leaves hold the median residual: boosting
for the absolute error. Sums of signs are whole numbers, rows are put into the order of their ids, and ties go to the
first feature and bin, so a fit doesn't depend on how its rows were partitioned: `fit_digests` tells. A sample without
rows gives no model, and rows of its horizon no predictions; null features fall into the last bin.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Training rows of a horizon that fits learn from, bins of a feature, and trees of a fit.
FIT_ROWS, BINS, ROUNDS = 4_000, 32, 12
#: The grid, in the order of nesting.
LEARNING_RATES, LEAVES, LEAST_ROWS = (0.1, 0.3), (4, 8), (20, 60)
MODELS = "regime string, horizon int, candidate string, rows long, model string, gains array<double>"


def candidates() -> list[dict]:
    """All candidates, numbered as they are nested: C01, C02, ..."""
    return [{"candidate": f"C{i:02d}", "learning_rate": a, "leaves": b, "least_rows": c} for i, (a, b, c) in enumerate(product(LEARNING_RATES, LEAVES, LEAST_ROWS), 1)]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1).astype(np.uint8) if x.shape[1] else np.zeros(x.shape, np.uint8)


def best_split(bins: np.ndarray, signs: np.ndarray, least: int) -> tuple[float, int, int] | None:
    """(gain, feature, last bin of the left side) of the best split of some rows; None where none gains."""
    n, width = bins.shape
    place = (bins + np.arange(width, dtype=np.int64) * BINS).ravel()
    count = np.bincount(place, minlength=width * BINS).reshape(width, BINS).cumsum(1)
    total = np.bincount(place, np.repeat(signs, width), minlength=width * BINS).reshape(width, BINS).cumsum(1)
    whole, right = signs.sum(), n - count
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = total**2 / count + (whole - total) ** 2 / right - whole**2 / n
    gain = np.where((count >= least) & (right >= least), gain, -1.0)
    at = int(gain.argmax())
    return (float(gain.flat[at]), *divmod(at, BINS)) if gain.flat[at] > 1e-9 else None


def grown(bins: np.ndarray, residuals: np.ndarray, leaves: int, least: int, gains: np.ndarray) -> dict:
    """One tree, best split first: feature, bin, left and right by node (-1 in leaves), and the value of each node."""
    signs = np.sign(residuals)
    tree = {"feature": [-1], "bin": [0], "left": [-1], "right": [-1], "value": [float(np.median(residuals))]}
    open_ = []

    def offer(node: int, rows: np.ndarray) -> None:
        if len(rows) >= 2 * least and (found := best_split(bins[rows], signs[rows], least)):
            heapq.heappush(open_, (-found[0], node, found, rows))

    offer(0, np.arange(len(bins)))
    for _ in range(leaves - 1):
        if not open_:
            break
        _, node, (gain, feature, last), rows = heapq.heappop(open_)
        gains[feature] += gain
        left = bins[rows, feature] <= last
        tree["feature"][node], tree["bin"][node] = feature, last
        for side, part in (("left", rows[left]), ("right", rows[~left])):
            tree[side][node] = len(tree["value"])
            for name, value in (("feature", -1), ("bin", 0), ("left", -1), ("right", -1), ("value", float(np.median(residuals[part])))):
                tree[name].append(value)
            offer(tree[side][node], part)
    return tree


def tree_values(tree: dict, bins: np.ndarray) -> np.ndarray:
    feature, last, left, right, value = (np.array(tree[k]) for k in ("feature", "bin", "left", "right", "value"))
    node = np.zeros(len(bins), np.int64)
    while (inner := feature[node] >= 0).any():
        here = node[inner]
        node[inner] = np.where(bins[inner, feature[here]] <= last[here], left[here], right[here])
    return value[node]


def fitted(x: np.ndarray, y: np.ndarray, candidate: dict, rounds: int) -> tuple[dict, np.ndarray]:
    """(model, gain of each feature) of rows in a fixed order."""
    edges = [np.unique(np.nanquantile(c, np.linspace(0, 1, BINS)[1:-1])) if np.isfinite(c).any() else np.zeros(0) for c in x.T]
    bins, start, gains = binned(x, edges), float(np.median(y)), np.zeros(x.shape[1])
    guess, trees = np.full(len(y), start), []
    for _ in range(rounds):
        tree = grown(bins, y - guess, candidate["leaves"], candidate["least_rows"], gains)
        trees.append(tree)
        guess = guess + candidate["learning_rate"] * tree_values(tree, bins)
    return {"edges": [e.tolist() for e in edges], "start": start, "rate": candidate["learning_rate"], "trees": trees}, gains


def guessed(model: dict, x: np.ndarray) -> np.ndarray:
    bins = binned(x, [np.array(e) for e in model["edges"]])
    return model["start"] + model["rate"] * sum((tree_values(t, bins) for t in model["trees"]), np.zeros(len(x)))


def fit_grid(train: DataFrame, regimes: dict[str, list[int]], grid: list[dict], most: int = FIT_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """regime, horizon, candidate, rows, model (JSON), gains of every fit.

    train: sample_id, horizon, actual, features (array). regimes: the places of the features that each may see.
    """
    place = F.shiftrightunsigned(F.xxhash64("sample_id"), 11) / F.lit(float(1 << 53))  # even over [0, 1)
    sizes = train.groupBy(F.col("horizon").alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    # About twice as many as are wanted, and the first of them: no task sorts a whole horizon.
    near = train.withColumn("_place", place).join(F.broadcast(sizes), F.col("horizon") == F.col("_h")).filter(F.col("_place") * F.col("_n") < 2 * most)  # one row a horizon
    first = Window.partitionBy("horizon").orderBy("_place", "sample_id")
    sample = near.withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= most)
    fits = F.explode(F.array(*[F.struct(F.lit(r).alias("regime"), F.lit(c["candidate"]).alias("candidate")) for r in regimes for c in grid])).alias("fit")
    own = F.col("features")
    for name, places in regimes.items():
        own = F.when(F.col("fit.regime") == name, F.array(*[F.get("features", F.lit(i)) for i in places])).otherwise(own)
    rows = sample.select("sample_id", "horizon", "actual", "features", fits).select("fit.regime", "horizon", "fit.candidate", "sample_id", "actual", own.alias("features"))
    known = {c["candidate"]: c for c in grid}

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("sample_id")
        model, gains = fitted(np.stack(frame["features"].to_numpy()).astype(float), frame["actual"].to_numpy(float), known[key[2]], rounds)
        return pd.DataFrame({"regime": [key[0]], "horizon": [key[1]], "candidate": [key[2]], "rows": [len(frame)], "model": [json.dumps(model)], "gains": [gains.tolist()]})

    return rows.groupBy("regime", "horizon", "candidate").applyInPandas(run, MODELS)


def predicted(rows: DataFrame, models: DataFrame, regimes: dict[str, list[int]], keep: list[str]) -> DataFrame:
    """keep, regime, candidate, prediction: what each fit of a row's horizon says of it.

    models: of `fit_grid`, one row a fit; their number is that of the grid, not of the data.
    """
    by_horizon: dict[int, list] = {}
    for r in models.select("regime", "horizon", "candidate", "model").collect():
        by_horizon.setdefault(r.horizon, []).append((r.regime, r.candidate, json.loads(r.model)))
    for fits in by_horizon.values():
        fits.sort(key=lambda f: f[:2])
    sent = rows.sparkSession.sparkContext.broadcast(by_horizon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            horizons = batch.column("horizon").to_numpy()
            for horizon, fits in sent.value.items():
                at = np.flatnonzero(horizons == horizon)
                if not len(at):
                    continue
                part = batch.take(pa.array(at))
                x = np.stack(part.column("features").to_numpy(zero_copy_only=False)).astype(float)
                for regime, candidate, model in fits:
                    made = [*(part.column(c) for c in keep), pa.array([regime] * len(at)), pa.array([candidate] * len(at)), pa.array(guessed(model, x[:, regimes[regime]]))]
                    yield pa.RecordBatch.from_arrays(made, names=[*keep, "regime", "candidate", "prediction"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*dict.fromkeys([*keep, "horizon", "features"])).mapInArrow(run, f"{kinds}, regime string, candidate string, prediction double")


def candidate_scores(predictions: DataFrame, grid: list[dict]) -> DataFrame:
    """regime, horizon, candidate and its parameters, n, mae and rmse as means over stations."""
    residual = F.col("actual") - F.col("prediction")
    cells = predictions.groupBy("regime", "horizon", "candidate", "station").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(residual)).alias("mae"), F.sqrt(F.avg(residual * residual)).alias("rmse"))
    macro = cells.groupBy("regime", "horizon", "candidate").agg(F.sum("n").alias("n"), F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"))
    told = predictions.sparkSession.createDataFrame([tuple(c.values()) for c in grid], "candidate string, learning_rate double, leaves int, least_rows int")
    return macro.join(F.broadcast(told), "candidate")  # one row a candidate


#: After MAE and RMSE: fewer leaves, more rows a leaf, the smaller id.
CAPACITY = (F.asc, "leaves"), (F.desc, "least_rows"), (F.asc, "candidate")


def ties() -> list:
    return [order(c) for order, c in CAPACITY]


def mean_over_regimes(scores: DataFrame) -> DataFrame:
    """Scores of each candidate at each horizon as means over the regimes."""
    return scores.groupBy("horizon", "candidate", "learning_rate", "leaves", "least_rows").agg(F.count(F.lit(1)).alias("regimes"), F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"))


def gain_shares(models: DataFrame, names: list[str], regimes: dict[str, list[int]]) -> DataFrame:
    """regime, horizon, candidate, place, feature, gain, share: features of each fit by gain, the name deciding ties."""
    named = F.lit(None).cast("string")
    for regime, places in regimes.items():
        named = F.when(F.col("regime") == regime, F.get(F.array(*[F.lit(names[i]) for i in places]), F.col("pos"))).otherwise(named)
    keys = ["regime", "horizon", "candidate"]
    rows = models.select(*keys, F.posexplode("gains").alias("pos", "gain")).withColumn("feature", named)
    by = Window.partitionBy(*keys)  # one row a feature
    return rows.select(*keys, F.row_number().over(by.orderBy(F.desc("gain"), "feature")).alias("place"), "feature", "gain", F.try_divide(F.col("gain"), F.sum("gain").over(by)).alias("share"))


def fit_digests(models: DataFrame) -> DataFrame:
    """name, digest of each fit's model."""
    return models.select(F.concat_ws("_", "regime", F.concat(F.lit("h"), F.col("horizon").cast("string")), "candidate").alias("name"), F.sha2("model", 256).alias("digest"))
