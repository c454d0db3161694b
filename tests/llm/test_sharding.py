import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from gridloom.llm import sharding
from gridloom.llm.queries import op4_shard_documents


def shard(doc_id: int, n: int) -> int:
    """Equal weights: the highest hash wins. Spark chains 64-bit xxHash over columns; an int column is 4 bytes."""
    def bid(i):
        h = 42
        for value, width in ((29, 4), (doc_id, 8), (i, 4)):
            h = xxhash.xxh64(value.to_bytes(width, "little"), seed=h).intdigest()
        return h >> 11

    return max(range(n), key=lambda i: (bid(i), -i))


def test_against_brute_force(spark, sf):
    rows = op4_shard_documents(spark, sf).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    slots = defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "key")
        assert r.shard == shard(r.doc_id, 8) and r.grown_shard == shard(r.doc_id, 9) and r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {tuple(r) for r in rows} == {tuple(r) for r in op4_shard_documents(spark, sf).collect()}


def test_weights_set_the_shares(spark):
    got = Counter(r.shard for r in sharding.assign_shards(spark.range(20000), "id", [1, 3, 0, 4]).collect())
    assert set(got) == {0, 1, 3} and abs(got[0] / 20000 - 1 / 8) < 0.02 and abs(got[3] / 20000 - 1 / 2) < 0.02


def test_edges(docs):
    assert sharding.shard_documents(docs([])).count() == 0
    hot = docs([(7, "same")] * 300 + [(None, None), (None, ""), (8, "x")]).withColumn("shard", F.lit("mine"))
    rows = sharding.shard_documents(hot).collect()
    assert len(rows) == 303 and {r.size for r in rows} == {5, 1, 2}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_clashing_columns_pass_through(spark):
    own = ("_n", "_h", "_bucket", "_b", "_rows", "_first", "_before", "_start", "_offset", "_shard", "slot", "c0", "c1", "Shard_")
    rows = spark.range(50).withColumn("shard", (F.col("id") % 3).cast("int")).withColumns({c: F.lit("mine") for c in own})
    got = sharding.number_slots(rows.union(rows))
    assert got.columns == ["id", "shard", *[c for c in own if c != "slot"], "slot"]
    by = defaultdict(list)
    for r in got.collect():
        by[r.shard].append(r.slot)
        assert {r[c] for c in own if c != "slot"} == {"mine"}
    assert {k: sorted(v) for k, v in by.items()} == {0: list(range(34)), 1: list(range(34)), 2: list(range(32))}
