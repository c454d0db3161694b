"""Ranked lexical search by the threshold algorithm over impact-sorted lists.

1. Items are reduced to their distinct terms with the times each comes. They are worked on in chunks of `ITEM_BYTES` of
   terms, so what is sent to the tasks doesn't grow with their number; most item tables are one chunk.
2. Forward index. One pass over whole texts keeps, for each document, its number of terms and how often each term of the
   items comes in it. Document frequencies, and the counts and lengths that the weights need, are sums over this table.
3. Search. Each task takes its rows of the index in blocks of `BLOCK_POSTINGS` postings. A block has, for every term, a
   list of its documents by falling impact. For an item, the lists of its terms are read in turn, so many rows deep; each
   document met is scored in full from the forward index; the search ends when the sum of the impacts at the depth
   reached, which bounds all documents not yet met, falls strictly below the k-th best score. Ties of the k-th score
   are all met, so the result is exact.
4. The k best of each block meet in one window by item, after a limit in each task: k rows a task and item.

A document that any block ranks below k others is below them overall, so no document is lost. Scores and weights are
those of `score` and `weight`. Rows of documents each count on their own, repeated ones too; ties go to the smaller id,
null ids last. Repeated rows of an item count once; null and empty texts have no terms and no results. Only `doc_id` and
`text`, `item_id` and `text` are read.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import packs, removed, tidy, whole_texts, written

K = 10
#: Bytes of item terms that are worked on at once, and postings of a block.
ITEM_BYTES, BLOCK_POSTINGS = 8 << 20, 1 << 20
#: Bytes of a long text that are split into terms at once; rows that are read of each list before the first look back.
SLICE, FIRST_ROWS = 1 << 20, 16
#: Every byte as it counts in a term: ASCII digits and letters, lower-cased, and all bytes of other code points.
FOLDED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def term_counts(text: str) -> tuple[Counter, int]:
    """How often each term comes in a text, as UTF-8, and the number of terms."""
    data = text.encode("utf-8", "surrogatepass").translate(FOLDED)
    if len(data) <= SLICE:
        words = data.split()
        return Counter(words), len(words)
    found, n, start = Counter(), 0, 0
    while start < len(data):
        end = data.find(b" ", start + SLICE)
        words = data[start : end if end >= 0 else len(data)].split()
        found.update(words)
        n, start = n + len(words), end if end >= 0 else len(data)
    return found, n


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms, times: the distinct terms of each distinct row of (item_id, text)."""

    def run(batches):
        for batch in batches:
            terms, times = [], []
            for text in whole_texts(batch.column("text")).to_pylist():
                found = sorted(term_counts(text)[0].items())
                terms.append([t for t, _ in found])
                times.append([n for _, n in found])
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(terms, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))], ["item_id", "terms", "times"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").distinct().mapInArrow(run, f"item_id {kind}, terms array<binary>, times array<long>")


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, times: a document's number of terms, and the terms of a vocabulary that it has."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @tidy
    def run(batches):
        known = sent.value
        for batch in batches:
            texts = whole_texts(batch.column("text"))
            for start, end in packs(texts):
                sizes, terms, times, ends = [], [], [], [0]
                for text in texts[start:end].to_pylist():
                    found, n = term_counts(text)
                    met = sorted((known[t], k) for t, k in found.items() if t in known)
                    terms += [t for t, _ in met]
                    times += [k for _, k in met]
                    sizes.append(n)
                    ends.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, end - start), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")


def weight(documents: int, frequency: int) -> int:
    """A term's weight, from all documents with terms and those that hold the term."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def score(times: np.ndarray, sizes: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What one term gives a document, but for its weight: by times in the document, its size, and all documents' sizes."""
    norm = 25 + (75 * sizes * documents) // length
    return (1_000_000_000 * times) // (1000 * times + 8 * norm)


class Block:
    """The impact-sorted lists and the forward index of some documents."""

    def __init__(self, docs: np.ndarray, null: np.ndarray, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, size: int) -> None:
        self.docs, self.null, self.starts, self.terms, self.impacts = docs, null, starts, terms, impacts
        rows = np.repeat(np.arange(len(docs)), np.diff(starts))
        order = np.lexsort((rows, -impacts, terms))
        self.list_rows, self.list_impacts = rows[order], impacts[order]
        self.lists = np.searchsorted(terms[order], np.arange(size + 1))
        self.wanted = np.zeros(size, np.int64)  # how often the item at hand has each term

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Full scores of documents by looking up all their terms."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        first = np.cumsum(sizes) - sizes
        at = np.repeat(self.starts[rows] - first, sizes) + np.arange(sizes.sum())
        return np.add.reduceat(self.wanted[self.terms[at]] * self.impacts[at], first)

    def top(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best documents of an item by score, then id; only scores above 0."""
        full = [(self.lists[t], self.lists[t + 1], n) for t, n in zip(terms, times, strict=True) if self.lists[t] < self.lists[t + 1] and self.list_impacts[self.lists[t]] > 0]
        self.wanted[terms] = times
        seen = np.zeros(len(self.docs), bool)
        best, found, depth, more = np.empty(0, np.int64), np.empty(0, np.int64), 0, FIRST_ROWS
        while full:
            met = np.unique(np.concatenate([self.list_rows[a + depth : min(a + depth + more, b)] for a, b, _ in full]))
            met = met[~seen[met]]
            seen[met] = True
            if len(met):
                best, found = np.concatenate((best, met)), np.concatenate((found, self.scores(met)))
                order = np.lexsort((self.docs[best], self.null[best], -found))[:k]
                best, found = best[order], found[order]
            depth, more = depth + more, more * 2
            full = [(a, b, n) for a, b, n in full if a + depth < b]
            threshold = sum(n * int(self.list_impacts[a + depth - 1]) for a, b, n in full)
            if not threshold or len(found) == k and threshold < found[-1]:
                break
        self.wanted[terms] = 0
        return best[found > 0], found[found > 0]


def searched(index: DataFrame, items: list[tuple], weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """item, doc_id, score: the k best of each block of a forward index, for items (term numbers, times)."""
    sent = index.sparkSession.sparkContext.broadcast((items, weights))

    def found_in(parts):
        items, weights = sent.value
        whole = pa.Table.from_batches(parts).combine_chunks()
        ids = whole.column("doc_id").combine_chunks()
        lists = whole.column("terms").combine_chunks()
        sizes = whole.column("n").to_numpy()
        starts = lists.offsets.to_numpy().astype(np.int64)
        terms, times = lists.flatten().to_numpy(), whole.column("times").combine_chunks().flatten().to_numpy()
        starts -= starts[0]
        impacts = weights[terms] * score(times, np.repeat(sizes, np.diff(starts)), documents, length)
        block = Block(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), starts, terms, impacts, len(weights))
        numbers, rows, scores = [], [], []
        for number, (item, often) in enumerate(items):
            best, found = block.top(item, often, k)
            numbers.append(np.full(len(best), number, np.int32))
            rows.append(best)
            scores.append(found)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers)), ids.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(scores))], ["item", "doc_id", "score"])

    @tidy
    def run(batches):
        parts, held = [], 0
        for batch in batches:
            parts.append(batch)
            held += len(batch.column("terms").flatten())
            if held >= BLOCK_POSTINGS:
                yield found_in(parts)
                parts, held = [], 0
        if held:
            yield found_in(parts)

    return index.filter(F.size("terms") > 0).select("doc_id", "n", "terms", "times").mapInArrow(run, "item int, doc_id long, score long")


def search_chunk(docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    """item, doc_id, score, rank of a bounded list of items (terms, times), numbered by their places; None without items."""
    if not rows:
        return None
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r.terms}))}
    index = written(forward_index(docs, vocabulary), "lexical-index")
    documents, length = index.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in counts:
        weights[term] = weight(documents, df)
    items = [(np.array([vocabulary[bytes(t)] for t in r.terms], np.int64), np.array(r.times, np.int64)) for r in rows]
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    found = searched(index, items, weights, documents, length, k)
    best = written(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "lexical-found")
    removed(index)
    return best


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, all with scores above 0."""
    spark = docs.sparkSession
    reduced = written(item_terms(items), "lexical-items").filter(F.size("terms") > 0)
    held = reduced.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 16))).first()[0] or 0
    chunks = -(-held // ITEM_BYTES)
    kind = items.schema["item_id"].dataType.simpleString()
    done = []
    for c in range(chunks):
        rows = reduced.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(chunks)) == c).collect()
        found = search_chunk(docs, rows, k)
        if found is None:
            continue
        names = F.broadcast(spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {kind}"))
        done.append(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEARCH_SQL = f"""
WITH words AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}')) AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
), held AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), sizes AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY r
), whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes
), weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, whole GROUP BY term, docs
), asked AS (
  SELECT i, item_id, term, count(*) AS qtf
  FROM (SELECT i, item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}')) AS term
        FROM (SELECT row_number() OVER () AS i, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark))) GROUP BY ALL
), scored AS (
  SELECT i, item_id, r, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (r) CROSS JOIN whole GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= {K}
"""
