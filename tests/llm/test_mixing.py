import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing
from gridloom.llm.queries import op1_mix_sources

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes: dict, weights: dict, share: float, epochs: float) -> dict:
    """Water-filling by sorting sources by cap over weight."""
    budget, free, out = share * sum(sizes.values()), sum(weights.values()), {}
    for s in sorted(sizes, key=lambda s: epochs * sizes[s] / weights[s]):
        out[s] = min(epochs * sizes[s], budget * weights[s] / free)
        budget, free = budget - out[s], free - weights[s]
    return out


def test_targets_and_amounts(spark):
    d = "/root/testdata/sf0.01"
    rows = op1_mix_sources(spark, d).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    sizes = defaultdict(int)
    for r in docs.values():
        sizes[r.source] += len(WORDS.findall(r.text or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    targets = filled(sizes, weights, 1.5, 2.0)
    taken = defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        source = docs[r.doc_id].source
        assert r.size == len(WORDS.findall(docs[r.doc_id].text or "")) and r.source_size == sizes[source]
        assert r.target == pytest.approx(targets[source]) and 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    largest = max(r.size for r in rows)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest / 2 + 1
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in op1_mix_sources(spark, d).collect()}


def test_cut_is_the_nearest(docs):
    rows = mixing.mix_counts(docs([(i, "w " * (i % 7 + 1), "a" if i % 3 else "b") for i in range(900)])).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert len(rows) == 2 and all(abs(r.t - r.g) <= 3.5 for r in rows)


def test_edges(spark, docs):
    assert mixing.mix_counts(docs([])).count() == 0
    rows = mixing.mix_counts(docs([(1, None, None), (None, "", "x"), (2, "a b", None), (2, "a b", None), (3, "c " * 10, "x")]).withColumn("h", F.lit(1)).withColumn("copies", F.lit("mine"))).collect()
    assert len(rows) == 5 and sum(r.size for r in rows) == 14
    assert mixing.mix_counts(docs([(1, None), (2, " ")])).agg(F.sum("taken")).first()[0] == 0


def test_mixed_rows_keep_columns(spark, docs):
    own = ("h", "_h", "_s", "_source", "_whole", "whole", "_cut", "cut", "_copy", "_left", "copies", "_of", "size", "target", "_slice")
    table = docs([(i, "w " * 10, f"s{i % 2}") for i in range(400)]).withColumns({c: F.lit(7) for c in own})
    weights = spark.createDataFrame([("s0", 1.0), ("s1", 3.0)], "source string, weight double")
    out = mixing.mix_sources(table, weights, share=1.0)
    assert out.columns == table.columns and out.select("h").distinct().collect()[0][0] == 7
    counts = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert counts == {"s0": 100, "s1": 300}
