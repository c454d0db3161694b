"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

The budget is `share` times all sizes. Every source asks for its weight's part; a source that asks for more than
`epochs` times its own size is clamped there, and what it leaves is dealt again among the others by weight, until none
asks for too much. Each document is then taken floor(target / source size) times, and the fraction that remains is
taken from a seeded prefix of the source: documents in the order of a 64-bit hash up to an exact cut.

The cut is found without moving rows between tasks by source: size sums by (source, slice of the hash range), summed
before the shuffle, show the slice where the wanted amount falls, and only that slice, one row of SLICES in a source,
is sorted by hash. A hot source costs no task more than another.

Defined cases: a null source is a source like any other and comes last; null or empty texts have size 0, are taken 0
words and get the copies of their source; rows equal in id and text stand or fall together; an empty table gives an
empty mix; extra columns pass through, and the operator's own columns replace clashing ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import WORD, checked_broadcast, fresh, written

#: Bits of the seeded hash, and those that name its slice.
BITS, SLICE_BITS = 60, 14


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(id_: Column, text: Column, seed: int) -> Column:
    """60 bits that decide the order within a source."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_, text), 64 - BITS)


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds `weight`: the given ones in turn over sources by code point, null last.

    Ranks come from a sort by range and the counts of its partitions, so that no task sees all sources.
    """
    part = written(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "mix-ranked")
    before = part.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("_before")
    given = F.array(*[F.lit(float(w)) for w in weights])
    return part.join(F.broadcast(before), "_part").withColumn("weight", F.get(given, (rank % len(weights)).cast("int"))).drop("_part")


def water_filled(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """From source, weight, source_size: adds `target`. Each round reads two sums; rounds end when none is clamped anew."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget, level = share * total, 0.0
    cap = epochs * F.col("source_size")
    while True:
        over = cap <= F.col("weight") * F.lit(level)
        held, free = sources.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        risen = max(level, (budget - (held or 0.0)) / free) if free else float("inf")
        if risen <= level * (1 + 1e-12) or risen == float("inf"):
            break
        level = risen
    asked = cap if risen == float("inf") else F.least(cap, F.col("weight") * F.lit(level))
    return sources.withColumn("target", asked.cast("double"))


def fraction_cuts(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """From sized (source, size, h) and sources (source, source_size, target): adds `whole` and `cut`.

    A document gets one copy more than `whole` if its h is below the cut; the cut is the one whose words come nearest
    to what remains of the target.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = sources.withColumn("whole", whole).withColumn("_left", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    slice_ = F.shiftright("h", BITS - SLICE_BITS)

    def crossed(sums: DataFrame, left: DataFrame) -> DataFrame:
        """_s, at, under, own: the first place of each source whose running sum passes what is left, and the sums below and of it."""
        running = F.sum("sum").over(Window.partitionBy("source").orderBy("at"))
        rows = sums.withColumn("upto", running).join(checked_broadcast(left), F.col("source").eqNullSafe(F.col("_s"))).filter(F.col("upto") > F.col("_left"))
        first = rows.groupBy("source", "_left").agg(F.min(F.struct("at", "upto", "sum")).alias("m"))
        return first.select(F.col("source").alias("_s"), F.col("m.at").alias("at"), (F.col("m.upto") - F.col("m.sum")).alias("under"), F.col("m.sum").alias("own"), "_left")

    left = plan.select(F.col("source").alias("_s"), "_left")
    found = crossed(sized.groupBy("source", slice_.alias("at")).agg(F.sum("size").alias("sum")), left)  # at most SLICES rows a source
    found = written(found.select("_s", F.col("at").alias("_slice"), (F.col("_left") - F.col("under")).alias("_left")), "mix-slices")
    inside = sized.join(checked_broadcast(found.select(F.col("_s").alias("_in"), "_slice")), F.col("source").eqNullSafe(F.col("_in")) & (slice_ == F.col("_slice")))
    exact = crossed(inside.groupBy("source", F.col("h").alias("at")).agg(F.sum("size").alias("sum")), found.select("_s", "_left"))
    nearer = 2 * (F.col("_left") - F.col("under")) >= F.col("own")
    cuts = written(exact.select(F.col("_s").alias("_of"), (F.col("at") + F.when(nearer, 1).otherwise(0)).alias("_cut")), "mix-cuts")
    return plan.join(checked_broadcast(cuts), F.col("source").eqNullSafe(F.col("_of")), "left").withColumn("cut", F.coalesce("_cut", F.lit(0).cast("long"))).drop("_left", "_of", "_cut")


def mix_plan(docs: DataFrame, weights: DataFrame | tuple[float, ...], share: float, epochs: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sized documents without texts, the plan: source, weight, source_size, target, whole, cut)."""
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), seeded(F.col("doc_id"), F.col("text"), seed).alias("h")), "mix-sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if isinstance(weights, DataFrame):
        named = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(named, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["weight"])
    else:
        sources = cyclic_weights(sources, weights)
    sources = written(sources, "mix-sources")
    return sized, written(fraction_cuts(sized, water_filled(sources, share, epochs)), "mix-plan")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """`rows` (with source and h) with their source's columns of the plan and `copies`, by a map-side join."""
    side = plan.select(F.col("source").alias("_s"), "source_size", "target", "whole", "cut")
    rows = rows.drop("source_size", "target", "whole", "cut", "copies")
    joined = rows.join(checked_broadcast(side), F.col("source").eqNullSafe(F.col("_s")))
    return joined.withColumn("copies", F.col("whole") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0)).drop("_s", "whole", "cut", "h")


def mix_counts(docs: DataFrame, weights: DataFrame | tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per document, without its text: doc_id, source, size, source_size, target, copies, taken."""
    sized, plan = mix_plan(docs, weights, share, epochs, seed)
    return with_copies(sized, plan).withColumn("taken", F.col("copies") * F.col("size"))


def mix_sources(docs: DataFrame, weights: DataFrame | tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the columns of `docs`."""
    _, plan = mix_plan(docs, weights, share, epochs, seed)
    h, source, whole, cut, copy = (fresh(x, docs) for x in ("h", "source", "whole", "cut", "copy"))
    side = checked_broadcast(plan.select(F.col("source").alias(source), F.col("whole").alias(whole), F.col("cut").alias(cut)))
    rows = docs.withColumn(h, seeded(F.col("doc_id"), F.col("text"), seed)).join(side, F.col("source").eqNullSafe(F.col(source)))
    copies = F.col(whole) + F.when(F.col(h) < F.col(cut), 1).otherwise(0)
    kept = rows.filter(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
