"""Comparison of models: pairs, best of several, gains, seeds, selection, neighbours on a map."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.aggregates import correlation, share
from gridloom.operators.stats import quantiles, ranked
from gridloom.sources.work import written

#: Fixed value: two-sided 95% quantile of Student's t with 4 degrees of freedom.
T_95_DF4 = 2.7764451051977987


def pairs(wide: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """model_a, model_b, a, b: absolute errors of each sample for each pair of models; linear in the samples."""
    e = {m: F.abs(F.col("actual") - F.col(m)) for m in models}
    items = [F.struct(F.lit(x).alias("model_a"), F.lit(y).alias("model_b"), e[x].alias("a"), e[y].alias("b")) for x, y in combinations(models, 2)]
    return wide.select(F.explode(F.array(*items)).alias("p")).select("p.*")


def complementarity(wide: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """How errors of two models move together, and how often either is strictly better."""
    keys, a, b = ["model_a", "model_b"], F.col("a"), F.col("b")
    met = written(pairs(wide, models).withColumn("d", a - b), "compare-pairs")
    moved = ranked(met, {"a": "ra", "b": "rb"}, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), correlation(a, b).alias("pearson"), correlation(F.col("ra"), F.col("rb")).alias("spearman"), F.avg("d").alias("mean_diff"),
        share(a < b).alias("a_better_pct"), share(b < a).alias("b_better_pct"), share(a == b).alias("tied_pct"),
    )
    return moved.join(quantiles(met, "d", keys, {"median_diff": 0.5}), keys)


def best_of(wide: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """Percent of samples where a model alone has the least error, and where several share it."""
    e = [F.abs(F.col("actual") - F.col(m)) for m in models]
    least = F.least(*e)
    winners = sum([(x == least).cast("int") for x in e[1:]], (e[0] == least).cast("int"))
    return wide.agg(F.count(F.lit(1)).alias("n"), *[share((x == least) & (winners == 1)).alias(f"{m}_best_pct") for m, x in zip(models, e, strict=True)], share(winners > 1).alias("tie_pct"))


def gain(scores: DataFrame, metric: str, a: str, b: str, keys: list[str]) -> DataFrame:
    """What going from model a to b gains, absolute and in percent."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col(metric)))
    rows = scores.groupBy(*keys).agg(pick(a).alias("before"), pick(b).alias("after"))
    return rows.withColumn("gain", F.col("before") - F.col("after")).withColumn("gain_pct", F.try_divide(F.col("gain") * 100, F.nullif(F.col("before"), F.lit(0.0))))


def verdicts(scores: DataFrame, metric: str, a: str, b: str, keys: list[str]) -> DataFrame:
    """win, loss or tie of model b against a in each group."""
    rows = gain(scores, metric, a, b, keys)
    return rows.withColumn("verdict", F.when(F.col("gain") > 0, "win").when(F.col("gain") < 0, "loss").when(F.col("gain") == 0, "tie"))


def seed_summary(scores: DataFrame, metric: str, keys: list[str]) -> DataFrame:
    x = F.col(metric)
    return scores.groupBy(*keys).agg(F.count(x).alias("seeds"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), (F.max(x) - F.min(x)).alias("range"))


def paired_interval(scores: DataFrame, metric: str, a: str, b: str, keys: list[str], seed: str = "seed", t: float = T_95_DF4) -> DataFrame:
    """Mean difference b - a over seeds with its t interval, seeds on either side, and whether all agree."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col(metric)))
    d = scores.groupBy(*keys, seed).agg((pick(b) - pick(a)).alias("d"))
    half = F.lit(t) * F.stddev_samp("d") / F.sqrt(F.count("d"))
    return d.groupBy(*keys).agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), (F.avg("d") - half).alias("low"), (F.avg("d") + half).alias("high"), F.count_if(F.col("d") < 0).alias("better"), F.count_if(F.col("d") > 0).alias("worse"), ((F.count_if(F.col("d") < 0) == F.count("d")) | (F.count_if(F.col("d") > 0) == F.count("d"))).alias("same_direction"))


def selected(scores: DataFrame, keys: list[str], ties: list) -> DataFrame:
    """The candidate with the least MAE, then RMSE, both in steps of 1e-12, then by the given columns."""
    step = lambda c: F.round(F.col(c) / 1e-12)
    order = [step("mae"), step("rmse"), *ties]
    return scores.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_turn") == 1).drop("_turn")


def candidates(spark, grid: dict[str, list]) -> DataFrame:
    """All combinations of a small grid of parameters, numbered in the order of nesting."""
    from itertools import product

    names = list(grid)
    return spark.createDataFrame([(i, *row) for i, row in enumerate(product(*grid.values()))], ["candidate", *names])


def edges(weights: DataFrame) -> DataFrame:
    """Weighted edges with km, and which source of each target is the nearest, and which the one of the highest weight."""
    by = Window.partitionBy("target")
    return weights.withColumn("nearest", F.row_number().over(by.orderBy("km", "source")) == 1).withColumn("weight_rank", F.row_number().over(by.orderBy(F.desc("weight"), "source"))).withColumn("heaviest", F.col("weight_rank") == 1)


def self_share(weights: DataFrame) -> DataFrame:
    """How much of the weight targets give to themselves and to others."""
    own = F.col("source") == F.col("target")
    return weights.agg(F.try_divide(F.sum(F.when(own, F.col("weight"))), F.sum("weight")).alias("self_share"), F.try_divide(F.sum(F.when(~own, F.col("weight"))), F.sum("weight")).alias("cross_share"))
