"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Such a pair has one place,
the length of its longest common prefix, before which the words agree and after which, without the differing code
point, they agree again. With `m` the longer length, that place is in one of `m` spots, and a range `[lo, hi)` of spots
fixes what the pair must share: the first `lo` and the last `m - hi` code points. The steps:

1. Blocks. Every word enters the two halves of the range for pairs in which it is the longer word, and for pairs in
   which it is one shorter. Words that share what a half fixes form a block; a pair is the business of one block only.
2. Hot blocks. A block with more than `BLOCK_WORDS` words or `BLOCK_CHARS` open code points is halved again, by Spark,
   round after round. A range of one spot leaves at most one word per letter, so this ends with small blocks, whatever
   words share; the rounds grow with the logarithm of the longest word. No word is left out anywhere.
3. Index. Within a block, 2-grams of the open range, with one code point of context at either side, are posted by
   position. A word merges the postings of its own grams by a heap: only words of its length at the same position, and
   words one shorter at the same position or the one before. One edit changes at most two of the longer word's
   `hi - lo + 1` grams, so candidates need `hi - lo - 1` in common.
4. Candidates are verified, and kept where their place lies in the block's range.

Words are distinct rows of (word, n). Empty tables give empty results; null words and null counts take no part. Repeated
rows of a word are added up first. Extra columns are not read. Ties of `n` go to the smallest word in code-point order.
Texts and words may have any length: a long word is halved until its open range is short.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import ascii_lower, checked_broadcast, tidy, written

#: Words and open code points of a block beyond which it is halved.
BLOCK_WORDS, BLOCK_CHARS = 128, 1 << 16
#: A near word is the form of another if it comes at least so many times as often.
RATIO = 10
BLOCK = ["m", "lo", "hi", "shared"]
LETTERS = "A-Za-zÀ-ÿ"


def words_of(docs: DataFrame, least: int = 7, every: int = 31) -> DataFrame:
    """word, n: runs of letters of whole texts with A-Z lower-cased, of at least `least` code points.

    A run of a document whose crc32 of `<doc_id>:<run>` is divisible by `every` loses the code point at that number
    modulo its length. Null texts have no runs; a null id counts as an empty one.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.left("run", at), F.right("run", F.length("run") - at - 1))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run"))).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return runs.filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def shared_key(word: str, m: Column, lo: Column, hi: Column) -> Column:
    """A hash of what words of a block share; equal hashes of different parts only cost time."""
    return F.xxhash64(F.left(F.col(word), lo), F.right(F.col(word), m - hi))


def halves(entries: DataFrame) -> DataFrame:
    """word, n, m, lo, hi of wider ranges, as entries of their two halves; a range of one spot stays as it is."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.explode(F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))).alias("part")
    split = entries.select("word", "n", "m", parts).select("word", "n", "m", "part.lo", "part.hi").filter("hi > lo")
    return split.withColumn("shared", shared_key("word", F.col("m"), F.col("lo"), F.col("hi")))


def block_entries(words: DataFrame) -> DataFrame:
    """word, n and its blocks, all of them small."""
    longer = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("m")
    entries = halves(words.select("word", "n", longer).select("word", "n", "m", F.lit(0).alias("lo"), F.col("m").alias("hi")))
    done = []
    while True:
        wide = (F.col("hi") - F.col("lo") > 1) & (F.col("in") > 1)
        hot = wide & ((F.col("in") > BLOCK_WORDS) | (F.col("in") * (F.col("hi") - F.col("lo")) > BLOCK_CHARS))
        large = written(entries.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("in")).filter(hot).select(*BLOCK), "spelling-large")
        if large.isEmpty():
            done.append(entries)
            break
        side = checked_broadcast(large)
        done.append(entries.join(side, BLOCK, "left_anti"))
        entries = written(halves(entries.join(side, BLOCK, "left_semi")), "spelling-halves")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def place(a: str, b: str, lo: int, hi: int) -> int:
    """Where two words part, `b` as long as `a` or one shorter, if that is in `[lo, hi)` and they are near; else -1."""
    at = lo
    while at < hi and at < len(b) and a[at] == b[at]:
        at += 1
    if at < hi and a[at + 1 :] == (b[at + 1 :] if len(a) == len(b) else b[at:]):
        return at
    return -1


def near_in_block(words: list[str], m: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Index pairs of near words of a block; the first is the longer, or the later of two of length m.

    Words of `m - 1` code points come first; they are only met, since pairs of two of them belong to another block.
    """
    need, same, shorter = hi - lo - 1, {}, {}
    for i, word in enumerate(words):
        open_part = f"\0{word}\1"[lo : len(word) - (m - hi) + 2]
        grams = [open_part[k : k + 2] for k in range(len(open_part) - 1)]
        if len(word) < m:
            for at, gram in enumerate(grams):
                shorter.setdefault((gram, at), []).append(i)
            continue
        if need > 0:
            lists = [found for at, gram in enumerate(grams) for found in (same.get((gram, at)), shorter.get((gram, at)), shorter.get((gram, at - 1))) if found]
            last, times = -1, 0
            for j in heapq.merge(*lists):
                times = times + 1 if j == last else 1
                last = j
                if times == need and place(word, words[j], lo, hi) >= 0:
                    yield i, j
        else:
            yield from ((i, j) for j in range(i) if place(word, words[j], lo, hi) >= 0)
        for at, gram in enumerate(grams):
            same.setdefault((gram, at), []).append(i)


PAIRS = "word string, near string, near_n long"


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n: every ordered pair of near words of (word, n)."""
    clean = words.filter(F.col("word").isNotNull() & F.col("n").isNotNull()).select("word", F.col("n").cast("long").alias("n"))
    entries = block_entries(clean)
    dealt = entries.repartition(*BLOCK).sortWithinPartitions(*BLOCK, F.length("word"), "word")

    @tidy
    def run(batches):
        block, members, counts = None, [], []

        def pairs():
            rows = []
            if len(members) > 1 and block is not None:
                for i, j in near_in_block(members, *block[:3]):
                    rows += [(members[i], members[j], counts[j]), (members[j], members[i], counts[i])]
            return rows

        out = []
        for batch in batches:
            m, lo, hi, shared, word, n = (batch.column(c).to_pylist() for c in (*BLOCK, "word", "n"))
            for key, w, k in zip(zip(m, lo, hi, shared, strict=True), word, n, strict=True):
                if key != block:
                    out += pairs()
                    block, members, counts = key, [], []
                    if len(out) > 20_000:
                        yield rows_batch(out)
                        out = []
                members.append(w)
                counts.append(k)
        out += pairs()
        yield rows_batch(out)

    return dealt.mapInArrow(run, PAIRS)


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    word, near, n = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], ["word", "near", "near_n"])


def roots(forms: DataFrame) -> DataFrame:
    """word, root of rows (word, form): forms followed to the last, by doubling the step.

    A form comes more often than its word, so chains end; their length grows with the logarithm of the counts.
    """
    found = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(found.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        found = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return found


def spelling_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for rows (word, n).

    The form of a word is its near word with the largest n, if that is at least `ratio` (more than 1) times the word's
    own; the root follows forms to the last, and is the word itself where there is none.
    """
    if ratio <= 1:
        raise ValueError("forms must come more often than their words")
    counted = written(words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").cast("long").alias("n")).filter(F.col("n").isNotNull()), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    near = near_pairs(counted).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    rows = counted.join(near, "word", "left").withColumn("form_n", -F.col("best.minus")).withColumn("is_form", F.col("form_n") >= ratio * F.col("n"))
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is_form"), F.col("best.near")).alias("form"), F.when(F.col("is_form"), F.col("form_n")).alias("form_n"))
    rows = written(rows, "spelling-forms")
    out = rows.join(roots(rows.filter("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_spellings(docs: DataFrame) -> DataFrame:
    """Forms of the words of at least 7 letters and 2 occurrences in all texts."""
    return spelling_forms(words_of(docs).filter("n >= 2"))


#: crc32 of a text of code points below 256: a table by the polynomial's rule, and a fold over the text's UTF-8 bytes.
CRC_SQL = """bits AS (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS entry FROM range(256) t(i)
), crc AS (SELECT list(entry ORDER BY i) AS entries FROM bits)"""


def crc_sql(text: str) -> str:
    """DuckDB: the unsigned crc32 of a text, beside a row of crc."""
    octets = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: xor(c >> 8, entries[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), 4294967295)"


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPELLING_SQL = f"""
WITH RECURSIVE {CRC_SQL}, runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[{LETTERS}]{{7,}}')) AS run FROM documents
), dealt AS (
  SELECT run, k, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h
  FROM (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL), crc
), cut AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, k FROM dealt
), words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), gone AS (
  SELECT DISTINCT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gone a JOIN gone b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gone a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gone a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form, CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), steps AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON s.at = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN steps s ON f.word = s.word JOIN forms e ON s.at = e.word WHERE e.form IS NULL
"""
