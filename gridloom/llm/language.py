"""Language identification by rank-order profiles of n-grams.

A profile lists the `PROFILE` most frequent n-grams of a language, of one to three code points, within words that have a
blank at either end. A document's own most frequent n-grams are held against each profile: an n-gram counts the
difference of its two ranks, or `PROFILE` where the profile lacks it. The language of the smallest sum, the out-of-place
distance, wins.

* Profiles come from all rows that may be learned from, by grouped sums: each task adds up its n-grams before they are
  shuffled by language and n-gram, and a limit per task precedes the window that ranks them.
* Scoring is one pass over whole texts. Profiles are brought to the tasks for at most `LANGUAGES` languages at once (in
  expectation, by hash); with more languages, further passes keep the better result. No language is left out.

Letters are code points of Unicode's letter categories, in lower case by code point; all else separates words. Ties of
frequency go to the smaller n-gram by `key`, ties of distance to the smallest language in code-point order. Null texts,
texts without a letter, and all texts where nothing was learned give `und` and score 0. Null languages are not learned;
an empty one is a language. Texts of any length are counted in slices, whole. Only `doc_id`, `text` and, for learning,
`lang` are read; other columns take no part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import packs, tidy, whole_texts, written
from gridloom.llm.spelling import CRC_SQL, crc_sql

#: N-grams of a profile, of a language and of a document.
PROFILE = 300
#: Languages whose profiles a task holds at once.
LANGUAGES = 512
#: Code points of a slice of a long text; n-grams that a task sums before it sends them.
SLICE, HELD = 1 << 20, 1 << 20
UNKNOWN, FOLDS = "und", 5
BLANK = 32


@functools.cache
def letters() -> np.ndarray:
    """The lower case of each code point that is a letter, and a blank for all others."""
    table = np.full(0x110000, BLANK, np.int64)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(text: str) -> Iterator[np.ndarray]:
    """Keys of all n-grams of a text, slice by slice: the first code point, plus the second times 2^21, plus the third
    times 2^42. An n-gram belongs to the slice that holds its end."""
    before = np.array([BLANK], np.int64)
    for start in range(0, len(text) + 1, SLICE):
        piece = text[start : start + SLICE] + " " * (start + SLICE > len(text))
        codes = letters()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]
        solid = codes != BLANK
        codes = codes[solid | np.concatenate((before[-1:] != BLANK, solid[:-1]))]
        run = np.concatenate((before, codes))
        pairs = run[:-1] + (run[1:] << 21)
        triples = (pairs[:-1] + (run[2:] << 42))[run[1:-1] != BLANK]
        if len(before) == 2:  # the pair and the triple that end before this slice are counted
            pairs = pairs[1:]
        yield np.concatenate((codes[codes != BLANK], pairs, triples))
        before = run[-2:]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and how often each comes."""
    parts = [np.unique(keys, return_counts=True) for keys in grams(text)]
    return parts[0] if len(parts) == 1 else summed(*map(np.concatenate, zip(*parts, strict=True)))


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n: n-grams of the texts of each language, summed by task; sums of several tasks are not yet added."""

    @tidy
    def run(batches):
        held = {}  # language: arrays of keys and counts

        def sent():
            for lang, parts in held.items():
                keys, counts = summed(*map(np.concatenate, zip(*parts, strict=True)))
                for at in range(0, len(keys), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[part]), pa.string()), pa.array(keys[part]), pa.array(counts[part])], ["lang", "gram", "n"])

        for batch in batches:
            texts = whole_texts(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            for start, end in packs(texts):
                by_lang = {}
                for lang, text in zip(langs[start:end], texts[start:end].to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).append(text)
                for lang, found in by_lang.items():
                    held.setdefault(lang, []).append(counted("\n".join(found)))
                if sum(len(keys) for parts in held.values() for keys, _ in parts) > HELD:
                    held = {lang: [summed(*map(np.concatenate, zip(*parts, strict=True)))] for lang, parts in held.items()}
                    if sum(len(keys) for parts in held.values() for keys, _ in parts) > HELD // 2:
                        yield from sent()
                        held = {}
        yield from sent()

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")


def profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """lang, gram, rank from 0: the `size` most frequent n-grams of each language of rows (lang, text)."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = gram_counts(known).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    return written(ranked.select("lang", "gram", (F.col("rank") - 1).cast("int").alias("rank")), "language-profiles")


def table(rows: list, size: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in code-point order, n-grams in order, and the rank of each n-gram (the last: of an absent one) in each
    language, -1 where a profile lacks it."""
    langs = sorted({r.lang for r in rows}, key=lambda s: s.encode())
    keys = np.unique(np.array([r.gram for r in rows], np.int64))
    ranks = np.full((len(keys) + 1, len(langs)), -1, np.int64)
    ranks[np.searchsorted(keys, [r.gram for r in rows]), [langs.index(r.lang) for r in rows]] = [r["rank"] for r in rows]
    return langs, keys, ranks


def judged(text: str, langs: list[str], keys: np.ndarray, ranks: np.ndarray, size: int) -> tuple[str, float] | None:
    """The nearest language, and one less its distance as a share of the largest possible; None without n-grams."""
    found, counts = counted(text)
    own = found[np.argsort(-counts, kind="stable")[:size]]
    if not len(own):
        return None
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    met = ranks[np.where(keys[at] == own, at, len(keys))]
    distance = np.where(met < 0, size, np.abs(met - np.arange(len(own))[:, None])).sum(axis=0)
    best = int(distance.argmin())
    return langs[best], 1 - float(distance[best]) / (size * len(own))


def identify(docs: DataFrame, learned: DataFrame, size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score of every row of (doc_id, text), by profiles (lang, gram, rank)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.lit(UNKNOWN).alias("lang_pred"), F.lit(-1.0).alias("score"))
    passes = -(-learned.select("lang").distinct().count() // LANGUAGES)
    for k in range(passes):
        part = learned.filter(F.pmod(F.xxhash64("lang"), F.lit(passes)) == k).collect()
        if not part:
            continue
        sent = spark.sparkContext.broadcast(table(part, size))

        @tidy
        def run(batches, sent=sent):
            langs, keys, ranks = sent.value
            for batch in batches:
                texts = whole_texts(batch.column("text"))
                best, scores = batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist()
                for start, end in packs(texts):
                    for i, text in enumerate(texts[start:end].to_pylist(), start):
                        new = judged(text, langs, keys, ranks, size)
                        if new and (new[1] > scores[i] or new[1] == scores[i] and new[0].encode() < best[i].encode()):
                            best[i], scores[i] = new
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(best, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "text", "lang_pred", "score"])

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select("doc_id", "lang_pred", F.greatest("score", F.lit(0.0)).alias("score"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of an id as text is divisible by `FOLDS`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == 0


def document_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: all documents, by profiles of those that are not held out."""
    found = identify(docs, profiles(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


LANGUAGE_SQL = f"""
WITH {CRC_SQL}, docs AS (
  SELECT row_number() OVER () AS r, doc_id, lang, text, regexp_matches(coalesce(text, ''), '\\p{{L}}') AS written,
         ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g')) || ' ' AS words,
         {crc_sql("CAST(doc_id AS VARCHAR)")} % {FOLDS} = 0 AS held_out
  FROM documents, crc
), codes AS (SELECT r, list_transform(string_split(words, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS c FROM docs WHERE written
), found AS (
  SELECT r, unnest(flatten([list_filter(c, lambda x: x <> {BLANK}), list_transform(range(1, len(c)), lambda i: c[i] + (c[i + 1] << 21)),
         list_transform(list_filter(range(1, len(c) - 1), lambda i: c[i + 1] <> {BLANK}), lambda i: c[i] + (c[i + 1] << 21) + (c[i + 2] << 42))])) AS gram FROM codes
), counts AS (SELECT r, gram, count(*) AS n FROM found GROUP BY ALL
), own AS (SELECT r, gram, row_number() OVER (PARTITION BY r ORDER BY n DESC, gram) - 1 AS own_rank FROM counts QUALIFY own_rank < {PROFILE}
), sums AS (SELECT lang, gram, sum(n) AS n FROM counts JOIN docs USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL
), learned AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) - 1 AS rank FROM sums QUALIFY rank < {PROFILE}
), distances AS (
  SELECT r, lang, CAST(sum(coalesce(abs(rank - own_rank), {PROFILE})) AS BIGINT) AS distance, count(*) AS grams
  FROM own CROSS JOIN (SELECT DISTINCT lang FROM learned) LEFT JOIN learned USING (lang, gram) GROUP BY ALL
), best AS (SELECT r, lang, 1 - distance / CAST({PROFILE} * grams AS DOUBLE) AS score FROM distances QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, lang) = 1)
SELECT doc_id, held_out, coalesce(b.lang, '{UNKNOWN}') AS lang_pred, coalesce(score, 0.0) AS score FROM docs LEFT JOIN best b USING (r)
"""
