"""Line dedup: lines are exploded with their positions, normalised and hashed; distinct documents are counted per
hash; lines over the threshold go, and each text is put together again by position.

Texts are never shuffled as lines. What travels is one slim row for each long enough line (document, position, 128-bit
hash), made once and written; positions to drop come back as one array per document, and the kept lines are picked out
of the text in place. A line that a third of all documents hold is counted after a partial sum. Repeated hashes, and
the documents that lose lines, are broadcast when they were counted and are few and small, and then no text is
shuffled; else they meet in joins that AQE can split.

Defined cases: a null or empty text is one empty line; lines are compared by their whole normalised text (128 bits of
hash); a null doc_id is one document, smaller than any other; rows that share a doc_id count as one document, and each
keeps or drops its own lines; an empty table gives an empty table; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import SPACES, ascii_lower, checked_broadcast, fresh, text_key, written


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, _text (a key of the text), pos, h1, h2 of each line whose key has at least `min_chars` code points."""
    lines = docs.select("doc_id", text_key(F.col("text")).alias("_text"), F.posexplode(F.split("text", "\n")).alias("pos", "_line"))
    lines = lines.filter(F.octet_length("_line") >= min_chars).withColumn("_key", line_key(F.col("_line"))).filter(F.length("_key") >= min_chars)
    return lines.select("doc_id", "_text", "pos", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(1), "_key").alias("h2"))


def repeated_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """h1, h2, keeper: hashes in at least `min_docs` distinct documents, and the largest doc_id that holds each."""
    by_doc = lines.select("h1", "h2", "doc_id").distinct()
    counted = by_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_docs"), F.max("doc_id").alias("keeper"))
    return counted.filter(F.col("_docs") >= min_docs).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "keeper")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """`docs` with `text` rebuilt from the kept lines, `n_lines` (before) and `n_dropped`."""
    lines = written(long_lines(docs, min_chars), "lines-long")
    often = checked_broadcast(written(repeated_lines(lines, min_docs), "lines-often"))
    hits = lines.join(often, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    id_, key, gone, text, parts = (fresh(x, docs) for x in ("id", "key", "gone", "text", "lines"))
    lost = written(hits.groupBy("doc_id", "_text").agg(F.collect_set("pos").alias(gone)).select(F.col("doc_id").alias(id_), F.col("_text").alias(key), gone), "lines-gone")
    rows = docs.drop("n_lines", "n_dropped").withColumn(text, text_key(F.col("text")))
    rows = rows.join(checked_broadcast(lost, size=4 * F.size(gone) + 32), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(text) == F.col(key)), "left")
    rows = rows.withColumn(parts, F.split(F.coalesce("text", F.lit("")), "\n")).withColumn("n_lines", F.size(parts).cast("long"))
    rows = rows.withColumn("n_dropped", F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
    # array_except keeps the order of positions and is linear in them.
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    rebuilt = F.array_join(F.transform(kept, lambda i: F.get(F.col(parts), i)), "\n")
    rows = rows.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(rebuilt))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


DIGEST_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, list[pos] AS line
  FROM (SELECT doc_id, list, unnest(range(1, len(list) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS list FROM documents))
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), over AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.doc_id, pos, line, over.k IS NOT NULL AND keyed.doc_id <> keeper AS gone
  FROM keyed LEFT JOIN over ON keyed.k = over.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
