import math
import random

import pytest

from gridloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, q string"


def brute(rows, every, k):
    ok = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, qa in ok.items():
        if a % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(qa, qb, strict=True)), b) for b, qb in ok.items() if b != a and len(qb) == len(qa))
            out += [(a, r, b, -s) for r, (s, b) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dim", "block"), [(300, 8, 64), (500, 3, 100), (40, 16, 8192)])
def test_against_brute_force(spark, monkeypatch, n, dim, block):
    rng = random.Random(n)
    monkeypatch.setattr(topk, "BLOCK", block)
    rows = [(i * 3 - 50, [rng.choice([rng.gauss(0, 0.3), 0.25, -0.5]) for _ in range(dim)]) for i in range(n)]
    rows += [(5000 + i, [0.25] * dim) for i in range(40)]  # ties
    rows += [(6000, None), (6010, [None] * dim), (6020, [math.nan] * dim), (6030, [math.inf] * dim), (None, [1.0] * dim), (6040, [1.0, 2.0]), (6050, [1.0, -3.0]), (6060, []), (6070, []), (7000, [0.0] * dim), (7010, [30.5, *[-9.0] * (dim - 1)])]
    df = spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], SCHEMA)
    assert sorted(map(tuple, topk.top_k(df, 10, 7).collect())) == brute(rows, 10, 7)


def test_repeats_and_empty(spark):
    rows = [(10, [1.0, 2.0])] * 3 + [(11, [1.0, 0.0])] * 2
    got = topk.top_k(spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA), 10, 5).collect()
    assert sorted(map(tuple, got)) == [(10, 1, 11, 64 * 64), (10, 2, 11, 64 * 64)]
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("chunk", "chunk_bytes"), [(5, 1 << 20), (256, 300)])
def test_more_bytes_than_are_broadcast(spark, monkeypatch, chunk, chunk_bytes):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(topk, "BROADCAST_BYTES", 100)
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA), 4, 3).collect())) == brute(rows, 4, 3)


def test_overflow_is_an_error(spark):
    for big in (1e17, 1e9, 3e307):
        with pytest.raises(ValueError, match="too large"):
            topk.top_k(spark.createDataFrame([(0, [big, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>"))
