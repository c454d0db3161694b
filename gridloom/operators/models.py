"""Learned models: boosted trees by Spark ML, and batch inference of any model over contexts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def boosted_trees(train: DataFrame, rows: DataFrame, features: list[str], label: str, rounds: int = 10, depth: int = 4, seed: int = 42) -> DataFrame:
    """`rows` with `prediction`, by trees fitted to the absolute error."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    model = GBTRegressor(featuresCol="_features", labelCol=label, lossType="absolute", maxIter=rounds, maxDepth=depth, seed=seed).fit(assembler.transform(train))
    return model.transform(assembler.transform(rows)).drop("_features")


def masked_l1(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute error over slots that were observed."""
    return rows.groupBy(*keys).agg(F.avg(F.when(F.col("observed"), F.abs(F.col("actual") - F.col("prediction")))).alias("loss"))


def infer(contexts: DataFrame, model: Callable[[np.ndarray], np.ndarray], column: str = "steps") -> DataFrame:
    """station, hour_idx, prediction: `model` maps an array (rows, steps) to predictions, one Arrow batch at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame[["station", "hour_idx"]].assign(prediction=model(np.stack(frame[column].to_numpy())).astype(float))

    return contexts.select("station", "hour_idx", column).mapInPandas(run, "station int, hour_idx int, prediction double")


def linear_fit(contexts: DataFrame, label: str, column: str = "steps", ridge: float = 1e-3) -> np.ndarray:
    """Least squares of a label on the steps of a context and a constant (the last weight), over all rows.

    Tasks add up products of steps; what meets is one small matrix a task, and what reaches the driver is their sum.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                x = np.column_stack([np.stack(frame[column].to_numpy()), np.ones(len(frame)), frame[label].to_numpy(float)])
                total = x.T @ x + (0 if total is None else total)
        if total is not None:
            yield pd.DataFrame({"place": np.arange(total.size), "part": total.ravel()})

    sums = contexts.select(column, label).mapInPandas(run, "place int, part double").groupBy("place").agg(F.sum("part").alias("part")).orderBy("place").collect()
    if not sums:
        raise ValueError("no rows to learn from")
    width = int(len(sums) ** 0.5)
    moments = np.array([r["part"] for r in sums]).reshape(width, width)
    return np.linalg.solve(moments[:-1, :-1] + ridge * np.eye(width - 1), moments[:-1, -1])


def linear(weights: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A model for `infer` from the weights of `linear_fit`."""
    return lambda steps: steps @ weights[:-1] + weights[-1]
