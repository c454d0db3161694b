"""Sharding by rendezvous hashing over weighted shards.

Every shard bids for a key with -weight / ln(u), u a hash of (key, shard) in (0, 1); the highest bid wins. The key and
the shards alone decide, so rows need no shuffle, and one more shard only wins rows for itself. Slots number the rows
of a shard from 0 without gaps: rows are counted by (shard, bucket of hash), the counts give each bucket its first
slot, and only rows of one bucket are sorted together. Equal rows are counted before the shuffle and dealt out again
after it, in runs of bounded length.

Defined cases: a null key is a key like any other; null texts have no bytes; rows equal in all slot columns take
neighbouring slots; an empty table gives no rows; other columns pass through, whatever their names, and an earlier
`slot` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one run of equal rows that are dealt out together.
RUN = 10_000


def rendezvous(key: Column, weights: list[float], seed: int = 29) -> Column:
    """The winning shard, 0 to len(weights) - 1, as int; among equal bids the lowest shard."""
    def bid(shard: int, weight: float) -> Column:
        hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, F.lit(shard)), 11)
        return F.lit(float(weight)) / -F.ln((hashed + F.lit(0.5)) / F.lit(float(1 << 53)))

    bids = [F.struct(bid(i, w).alias("bid"), F.lit(-i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    if not bids:
        raise ValueError("no shard has a weight above 0")
    best = F.greatest(*bids) if len(bids) > 1 else bids[0]
    return (-best["shard"]).cast("int")


def assign_shards(df: DataFrame, key: str, weights: list[float], column: str = "shard", seed: int = 29) -> DataFrame:
    """`df` with the shard of each row's key; no shuffle."""
    return df.withColumn(column, rendezvous(F.col(key), weights, seed))


def number_slots(df: DataFrame, buckets: int = 4096) -> DataFrame:
    """`df` with `slot`: 0, 1, ... within each shard, the same at every run.

    `buckets` times the shards bounds what is counted; a bucket of a shard is the unit that one task sorts.
    """
    out = [c for c in df.columns if c.lower() != "slot"]
    columns = [f"c{i}" for i in range(len(out))]  # the operator's own columns can't clash with these
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(out, columns, strict=True)])
    runs = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", F.xxhash64(*columns)).withColumn("shard", F.col(columns[out.index("shard")]))
    runs = runs.withColumn("_bucket", F.shiftrightunsigned("_h", 64 - (buckets - 1).bit_length()).cast("int"))
    counts = runs.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_rows"))
    first = F.sum("_rows").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_rows")
    counts = counts.select(F.col("shard").alias("_shard"), F.col("_bucket").alias("_b"), first.alias("_first"))
    in_bucket = Window.partitionBy("shard", "_bucket").orderBy("_h", *columns)
    before = F.sum("_n").over(in_bucket) - F.col("_n")
    placed = runs.withColumn("_before", before).join(counts, F.col("shard").eqNullSafe(F.col("_shard")) & (F.col("_bucket") == F.col("_b")))
    starts = placed.withColumn("_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(RUN).cast("long"))))
    offset = F.explode(F.sequence(F.col("_start"), F.least(F.col("_n"), F.col("_start") + RUN) - 1))
    dealt = starts.withColumn("_offset", offset)
    return dealt.select(*[F.col(n).alias(c) for n, c in zip(columns, out, strict=True)], (F.col("_first") + F.col("_before") + F.col("_offset")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document under equal weights."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    slim = assign_shards(slim, "doc_id", [1.0] * shards)
    slim = assign_shards(slim, "doc_id", [1.0] * (shards + 1), "grown_shard")
    slotted = number_slots(slim)
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
