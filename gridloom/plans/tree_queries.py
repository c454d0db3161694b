"""Queries over grids of boosted trees: scores, selection, importances, refits. Eight candidates, R0 to R2, four horizons."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.digests import table_digest
from gridloom.operators import compare, features, governance, samples, trees
from gridloom.plans.base import STATIONS, TARGET, TIME, candidates, query, rounded
from gridloom.plans.panel_queries import OTHERS, RAIN, wide_panel
from gridloom.sources.work import written

NAMES = features.sample_names("R2", TARGET, OTHERS, STATIONS, 17, RAIN)
REGIMES = {r: [NAMES.index(c) for c in features.sample_names(r, TARGET, OTHERS, STATIONS, 17, RAIN)] for r in ("R0", "R1", "R2")}
KEEP = ["sample_id", "station", "horizon", "partition", "actual"]


def tree_rows(spark, sf):
    """sample_id, station, horizon, partition, actual, features of all eligible samples, stored."""
    wide = wide_panel(spark, sf)
    chosen = samples.eligible(candidates(spark, sf))
    matrix = features.sample_matrix(wide, chosen, "R2", TARGET, OTHERS, STATIONS, 17, TIME.start, RAIN)
    made = matrix.select("station", "horizon", "target_idx", F.array(*[F.col(c).cast("float") for c in NAMES]).alias("features"))
    rows = chosen.select("sample_id", "partition", "station", "horizon", "target_idx").join(made, ["station", "horizon", "target_idx"])
    truth = wide.select("station", F.col("hour_idx").alias("target_idx"), F.col(TARGET).alias("actual"))  # observed at targets
    return written(rows.join(truth, ["station", "target_idx"]).select(*KEEP, "features"), "tree-rows")


def fits(rows):
    """All fits, stored: they learn from the training partition."""
    return written(trees.fit_grid(rows.filter(F.col("partition") == "train"), REGIMES, trees.candidates()), "tree-fits")


def scores_of(rows, models):
    """Scores of all candidates over the whole validation partition, stored."""
    found = trees.predicted(rows.filter(F.col("partition") == "validation"), models, REGIMES, KEEP)
    return written(trees.candidate_scores(found, trees.candidates()), "tree-scores")


@query()
def tree_grid(spark, sf):
    """Scores of every candidate in every regime and horizon, and which is selected."""
    rows = tree_rows(spark, sf)
    scores = scores_of(rows, fits(rows))
    best = compare.selected(scores, ["regime", "horizon"], trees.ties()).select("regime", "horizon", "candidate", F.lit(True).alias("_best"))
    marked = scores.join(best, ["regime", "horizon", "candidate"], "left").withColumn("selected", F.col("_best").isNotNull()).drop("_best")
    return rounded(marked.select("regime", "horizon", "candidate", "learning_rate", "leaves", "least_rows", "n", "mae", "rmse", "selected"))


@query()
def tree_selection(spark, sf):
    """The candidate of each horizon by the mean over regimes, and then by capacity."""
    rows = tree_rows(spark, sf)
    best = compare.selected(trees.mean_over_regimes(scores_of(rows, fits(rows))), ["horizon"], trees.ties())
    return rounded(best.select("horizon", "candidate", "regimes", "leaves", "least_rows", "mae", "rmse"))


@query()
def tree_importances(spark, sf):
    """Features by gain in the selected fits; shares of a fit add up to 1."""
    rows = tree_rows(spark, sf)
    models = fits(rows)
    best = compare.selected(scores_of(rows, models), ["regime", "horizon"], trees.ties()).select("regime", "horizon", "candidate")
    return rounded(trees.gain_shares(models.join(best, ["regime", "horizon", "candidate"], "left_semi"), NAMES, REGIMES))


@query()
def refit_compare(spark, sf):
    """Fits and test predictions of two runs over other partitions of the rows: same, or what differs, by name."""
    rows = tree_rows(spark, sf)
    runs = []
    for dealt in (rows, rows.repartition(7, "sample_id")):
        models = fits(dealt)
        found = trees.predicted(dealt.filter(F.col("partition") == "test"), models, REGIMES, ["sample_id", "horizon"])
        name = F.concat_ws("_", F.lit("predictions"), "regime", "candidate").alias("name")
        digests = table_digest(found.select(name, "sample_id", "horizon", "prediction"), ["sample_id", "prediction"], ["name"])
        runs.append(trees.fit_digests(models).unionByName(digests.select("name", "digest")))
    return governance.drift(*runs)
