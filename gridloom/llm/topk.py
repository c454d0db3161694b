"""Exact top-k search by inner product over a bit-sliced index.

Vectors are quantised to integers and cut into blocks of rows. A block keeps one bitmap per component and bit. For a
query, the score of all rows of a block is added up as bit slices: every bitmap enters with the powers of two of its
weight, and carry-save adders (three bitmaps in, a sum and a carry out) reduce them to one bitmap per bit of the
score. The best rows are then picked from the most significant slice downward; rows that tie at the boundary are
resolved exactly, smaller ids first. Negative weights use the complement of a bitmap and a constant.

Queries are grouped into chunks; every chunk meets every block of the same number of components. The chunks are
broadcast after a check of their bytes, else they are joined by a shuffle on the chunk. Each pair of a block and a
query leaves at most k rows, and a window over those picks the result.

Defined cases: vectors that are null or hold null or non-finite components take no part; a vector scores against those
of its own length; rows with the query's own id are its own row and no candidates; equal queries count once; extra
columns are ignored; an empty table gives no rows. Quantised components must stay below 2^31 and scores below 2^62.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import BROADCAST_BYTES, written

#: Rows of a block; queries of a chunk, about, and their bytes.
BLOCK, CHUNK, CHUNK_BYTES = 8192, 256, 2 << 20


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantised(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def sliced(matrix: np.ndarray) -> tuple[np.ndarray, int]:
    """(bitmaps [component, bit, byte], offset): the bits of matrix - offset, rows along the bytes, 64 rows a word."""
    offset = int(matrix.min()) if matrix.size else 0
    shifted = (matrix - offset).astype(np.uint64)
    bits = max(1, int(shifted.max()).bit_length()) if matrix.size else 1
    rows = -(-len(matrix) // 64) * 64
    out = np.zeros((matrix.shape[1], bits, rows // 8), np.uint8)
    for b in range(bits):
        plane = np.zeros((matrix.shape[1], rows), np.uint8)
        plane[:, : len(matrix)] = ((shifted >> np.uint64(b)) & np.uint64(1)).T
        out[:, b] = np.packbits(plane, axis=1, bitorder="little")
    return out, offset


def added(slices: np.ndarray, offset: int, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """(bitmaps of the score from the least significant bit on, the constant to add) for one query."""
    bits = slices.shape[1]
    full, size = (1 << bits) - 1, np.abs(query)
    constant = int((query * offset).sum()) - int(size[query < 0].sum()) * full
    words = slices.view(np.uint64)
    negative = np.where(query < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    levels: list[list[np.ndarray]] = []
    for p in range(int(size.max()).bit_length() if size.size else 0):
        chosen = np.flatnonzero((size >> p) & 1)
        for b in range(bits) if len(chosen) else ():
            while len(levels) <= p + b:
                levels.append([])
            levels[p + b].append(words[chosen, b] ^ negative[chosen, None])
    out: list[np.ndarray] = []
    p = 0
    while p < len(levels):
        stack = np.concatenate(levels[p]) if levels[p] else np.zeros((0, words.shape[2]), np.uint64)
        while len(stack) > 1:
            n = len(stack) // 3
            if n:
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                both = a ^ b
                stack, carry = np.concatenate([both ^ c, stack[3 * n :]]), (a & b) | (both & c)
            else:
                stack, carry = (stack[0] ^ stack[1])[None], (stack[0] & stack[1])[None]
            if p + 1 == len(levels):
                levels.append([])
            levels[p + 1].append(carry)
        out.append(stack[0] if len(stack) else np.zeros(words.shape[2], np.uint64))
        levels[p], p = [], p + 1
    return out, constant


def best(score: list[np.ndarray], there: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows among those in bitmap `there`, ties by position."""
    sure, open_ = np.zeros_like(there), there
    count = lambda x: int(np.bitwise_count(x).sum())
    if count(there) > k:
        for bitmap in reversed(score):
            high = open_ & bitmap
            n = count(sure | high)
            if n > k:
                open_ = high
            else:
                sure, open_ = sure | high, open_ & ~bitmap
                if n == k:
                    open_ = np.zeros_like(there)
                    break
    rows = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    top = rows(sure)
    return np.concatenate([top, rows(open_)[: k - len(top)]])


def values(score: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Scores of the rows at some positions, read from the slices."""
    out = np.zeros(len(at), np.int64)
    for p, bitmap in enumerate(score):
        out += ((bitmap.view(np.uint8)[at >> 3] >> (at & 7)) & 1).astype(np.int64) << p
    return out


def build_index(vectors: DataFrame) -> DataFrame:
    """From vec_id and q (quantised): blocks of dim, ids, bits, offset, slices. Rows of a block go by id."""
    def run(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            ids, q = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("q")
            lengths = q.value_lengths().to_numpy(zero_copy_only=False)
            flat, starts = q.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
            for dim in np.unique(lengths):
                own = np.flatnonzero(lengths == dim)
                held.setdefault(int(dim), []).append((ids[own], flat[starts[own][:, None] + np.arange(dim)]))
                if sum(len(i) for i, _ in held[dim]) >= BLOCK:
                    yield from blocks(int(dim), held.pop(int(dim)))
        for dim, parts in held.items():
            yield from blocks(dim, parts)

    def blocks(dim, parts):
        ids, matrix = np.concatenate([i for i, _ in parts]), np.concatenate([m for _, m in parts])
        order = np.argsort(ids, kind="stable")
        ids, matrix = ids[order], matrix[order]
        for a in range(0, len(ids), BLOCK):
            slices, offset = sliced(matrix[a : a + BLOCK])
            row = {"dim": [dim], "ids": [ids[a : a + BLOCK].astype(np.int64).tobytes()], "bits": [slices.shape[1]], "offset": [offset], "slices": [slices.tobytes()]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("bits", pa.int32()), ("offset", pa.int64()), ("slices", pa.binary())]))

    return vectors.mapInArrow(run, "dim int, ids binary, bits int, offset long, slices binary")


def search(index: DataFrame, queries: DataFrame, n_queries: int, held: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of the index for each of so many queries (vec_id, q) and bytes."""
    chunks = max(1, -(-n_queries // CHUNK), -(-held // CHUNK_BYTES))
    named = queries.dropDuplicates(["vec_id", "q"]).select(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("_chunk"), F.size("q").alias("_dim"), F.struct("vec_id", "q").alias("_query"))
    grouped = named.groupBy("_chunk", "_dim").agg(F.collect_list("_query").alias("asked"))
    parts = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    few = held <= BROADCAST_BYTES
    if few:  # blocks may be fewer than cores; pairs of block and chunk are dealt out
        parts = parts.repartition(F.col("chunk"), F.xxhash64("ids"))
    pairs = parts.join(F.broadcast(grouped) if few else grouped, (F.col("chunk") == F.col("_chunk")) & (F.col("dim") == F.col("_dim")))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                slices = np.frombuffer(row["slices"], np.uint8).reshape(row["dim"], row["bits"], -1) if row["dim"] else np.zeros((0, 1, -(-len(ids) // 64) * 8), np.uint8)
                whole = np.packbits(np.arange(slices.shape[2] * 8) < len(ids), bitorder="little")
                found = []
                for asked in row["asked"]:
                    own = asked["vec_id"]
                    query = np.array(asked["q"], np.int64)
                    there = whole.copy()
                    for at in range(np.searchsorted(ids, own), np.searchsorted(ids, own, "right")) if own is not None else ():
                        there[at >> 3] &= 0xFF ^ (1 << (at & 7))
                    score, constant = added(slices, row["offset"], query)
                    at = best(score, there.view(np.uint64), k)
                    found.append((np.full(len(at), own), ids[at], values(score, at) + constant))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    near = pairs.select("dim", "ids", "bits", "offset", "slices", "asked").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """Rows whose vec_id is divisible by `every` as queries against all rows; rows without an id take no part."""
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", quantised(F.col("embedding"), scale).alias("q"))
    # In doubles, which don't overflow: the largest component, and the largest square of a vector's length.
    wide = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.transform("embedding", lambda x: F.abs(F.floor(x.cast("double") * scale).cast("double"))).alias("q"))
    square = F.aggregate("q", F.lit(0.0), lambda acc, x: acc + x * x)
    counts = wide.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1)), F.max(F.array_max("q")), F.max(square), F.sum(F.when(F.col("vec_id") % every == 0, F.size("q") * 8 + 32))).first()
    if (counts[2] or 0.0) >= 2.0**31 or (counts[3] or 0.0) >= 2.0**62:
        raise ValueError("components or scores are too large for exact sums in 64 bits")
    dealt = rows.repartition(max(1, -(-counts[0] // BLOCK)), F.xxhash64("vec_id", "q"))
    return search(written(build_index(dealt), "bit-slices"), rows.filter(F.col("vec_id") % every == 0), counts[1], counts[4] or 0, k)


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
