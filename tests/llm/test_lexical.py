import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from gridloom.llm import lexical
from gridloom.llm.queries import op13_lexical_search

OUT = {chr(c) for c in range(128) if not chr(c).isalnum()}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return "".join(" " if c in OUT else c for c in (text or "").translate(LOWER)).split(" ")


def brute(docs, items, k):
    """(item_id, rank, doc_id, score) by the definition, every document scored for every item."""
    counts = [(i, Counter(t for t in terms(text) if t)) for i, text in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, length, df = len(counts), sum(n for _, _, n in counts), Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c, n in counts:
            m = 25 + (75 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t and t in c)
            found += [(-s, i is None, i or 0, i)] * (s > 0)
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["The", "É", "è", "naïve", "日本", "a b"]
    text = lambda most: " ".join(rng.choice(words[: rng.choice([4, 20, 46])]) + rng.choice(["", ".", "_x", "\n"]) for _ in range(rng.randint(1, most)))
    docs = [(i * 7 % 1000, text(60)) for i in range(n)] + [(2000, None), (2001, ""), (2002, "!!! ..."), (5, "w1 w2 w3"), (5, "w1 w2 w3"), (None, "w1 w2 w3"), (4, "w1 w2 w3")]
    items = [(i, text(12)) for i in range(12)] + [(50, None), (51, ""), (52, "absent_word"), (53, "w1 w1 w1 w2"), (53, "w1 w1 w1 w2"), (None, "w3 the THE")]
    return docs, items


@pytest.mark.parametrize(("n", "k", "block", "first", "chars", "item_bytes"), [(300, 10, 1 << 20, 16, 1 << 20, 8 << 20), (300, 3, 50, 1, 4, 300), (40, 100, 1, 2, 1, 8 << 20)])
def test_against_brute_force(spark, monkeypatch, n, k, block, first, chars, item_bytes):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(lexical, "FIRST_ROWS", first)
    monkeypatch.setattr(lexical, "SLICE", chars)
    monkeypatch.setattr(lexical, "ITEM_BYTES", item_bytes)
    docs, items = corpus(n, n)
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, item_id string, score int").repartition(3)
    i = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    assert rows_of(lexical.search(d, i, k)) == brute(docs, items, k)


def test_search_stops_before_the_end_of_the_lists():
    """A few documents are far better than thousands of others, which are never looked up."""
    n = 5000
    docs, impacts = np.arange(n), np.where(np.arange(2 * n) < 40, 1000, 1)
    block = lexical.Block(docs, np.zeros(n, bool), np.arange(0, 2 * n + 1, 2), np.tile([0, 1], n), impacts, 2)
    looked_up, plain = [], block.scores
    block.scores = lambda rows: looked_up.append(len(rows)) or plain(rows)
    best, found = block.top(np.array([0, 1]), np.array([1, 1]), 10)
    assert best.tolist() == list(range(10)) and found.tolist() == [2000] * 10 and sum(looked_up) < 200


def test_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert lexical.search(docs([(1, "word")]).limit(0), items).count() == 0
    assert lexical.search(docs([(1, "word")]), items.limit(0)).count() == 0
    assert lexical.search(docs([(1, None)]), items).count() == 0


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({lexical.SEARCH_SQL})").fetchall()
    assert rows_of(op13_lexical_search(spark, sf)) == sorted(want, key=repr)
