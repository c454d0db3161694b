"""Secret scans with corpus-wide ownership frequency.

Three patterns find candidates in each text. The hash of every candidate's value is then counted over the corpus by
distinct owners and repositories: a value that several owners or many repositories hold is a copied example, one that
few repositories of one owner hold looks live. Each candidate gets one span more, of kind `shared` or `live`, over its value.

Positions come without Python: the pieces between matches (split) and the matches (regexp_extract_all) of the same
pattern alternate, so running sums of their lengths are the starts and ends, in code points.

Defined cases: null texts are empty; a null owner or repository is one owner or repository; equal rows are scanned
once each and counted once; an empty table gives an empty table; values are compared by 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import text_key, written

#: The patterns by kind, in the order of kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KEYWORD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Least characters of the value of an assignment; those of the other kinds stand in their patterns, which is the same
#: for runs of one class.
ASSIGN_LEAST = 12
#: Matches whose lengths are summed at a time.
BLOCK = 256
KINDS = ("assign", "access", "hex", "live", "shared")


def running(lengths: Column) -> Column:
    """Starts and ends from lengths of gaps and matches.

    Arrays that grow by one are copied at each step, so sums run in blocks of `BLOCK`, and over the blocks' totals.
    """
    blocks = F.when(F.size(lengths) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array())
    total = lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x["gap"] + x["n"])
    bases = lambda parts: F.aggregate(parts, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + total(x))))

    def spans(block: Column, base: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            return F.struct((start + x["n"]).alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), (start + x["n"]).alias("end")))).alias("spans"))

        return F.aggregate(block, F.struct(base.alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans")), add)["spans"]

    return F.element_at(F.transform(F.array(blocks), lambda parts: F.flatten(F.zip_with(parts, F.slice(bases(parts), F.lit(1), F.size(parts)), spans))), 1)


def of_kind(spans: str, kind: int) -> Column:
    """How many spans are of a kind. The lambda takes the span alone: a second parameter would be its index."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def matches(text: Column, kind: int, pattern: str, group: int = 0) -> Column:
    """Array of (start, kind, end, value_start, value): all matches of `pattern`, in order."""
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(F.transform(F.slice(gaps, 1, F.size(whole)), F.length), F.transform(whole, F.length), lambda gap, n: F.struct(gap.alias("gap"), n.alias("n")))
    # Bound to a lambda's variable, so that the matches are found once and not in each turn of the loops below.
    ends = F.element_at(F.transform(F.array(lengths), running), 1)
    # A value ends where its match ends.
    return F.zip_with(ends, value, lambda s, v: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), (s["end"] - F.length(v)).alias("value_start"), v.alias("value")))


def base_spans(docs: DataFrame) -> DataFrame:
    """`docs` with `found`: the base candidates of every text, by start and then kind."""
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value_start:int,value:string>>)")
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(matches(text, 0, ASSIGN, 2), lambda m: F.length(m["value"]) >= ASSIGN_LEAST)
    found = F.concat(
        F.when(F.col("text").rlike(KEYWORD), assign).otherwise(none),
        F.when(F.col("text").contains("AKIA") & F.col("text").rlike(ACCESS), matches(text, 1, ACCESS)).otherwise(none),
        F.when(F.col("text").rlike(HEX), matches(text, 2, HEX)).otherwise(none),
    )
    return docs.withColumn("found", F.array_sort(found))


def ownership(candidates: DataFrame) -> DataFrame:
    """v1, v2, owners, repos: distinct owners and repositories of each value. Distinct pairs are made before counting."""
    pairs = candidates.select("v1", "v2", "owner", "repo").distinct()
    by_owner = pairs.groupBy("v1", "v2", "owner").agg(F.count(F.lit(1)).alias("_repos"))
    return by_owner.groupBy("v1", "v2").agg(F.count(F.lit(1)).alias("owners"), F.sum("_repos").alias("repos"))


def scan(docs: DataFrame, owner: Column | None = None, repo: Column | None = None, shared_owners: int = 2, shared_repos: int = 4) -> DataFrame:
    """doc_id, base, spans and counts of every row: arrays of (start, kind, end); spans hold the base ones and the added ones.
    counts holds (start, end, owners, repos) of each value.

    owner and repo default to `source` and to `source` with `lang`. A value with at least `shared_owners` owners or
    `shared_repos` repositories is `shared`.
    """
    owner, repo = owner if owner is not None else F.col("source"), repo if repo is not None else F.struct("source", "lang")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("_text"), "text", owner.alias("owner"), repo.alias("repo"))
    rows = written(base_spans(rows).drop("text"), "secret-spans")
    hashed = rows.filter(F.size("found") > 0).select("doc_id", "_text", "owner", "repo", F.explode("found").alias("m"))
    hashed = hashed.select("*", F.xxhash64("m.value").alias("v1"), F.xxhash64(F.lit(1), "m.value").alias("v2"))
    owned = ownership(hashed).select(F.col("v1").alias("_v1"), F.col("v2").alias("_v2"), "owners", "repos")
    judged = hashed.join(owned, (F.col("v1") == F.col("_v1")) & (F.col("v2") == F.col("_v2")))
    kind = F.when((F.col("owners") >= shared_owners) | (F.col("repos") >= shared_repos), KINDS.index("shared")).otherwise(KINDS.index("live"))
    added = judged.groupBy("doc_id", "_text").agg(F.collect_set(F.struct(F.col("m.value_start").alias("start"), kind.alias("kind"), F.col("m.end").alias("end"), "owners", "repos")).alias("added"))
    added = added.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_key"), "added")
    base = F.transform("found", lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    more = F.transform("added", lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    counts = F.array_sort(F.transform("added", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["owners"].alias("owners"), m["repos"].alias("repos"))))
    none = F.expr("cast(array() as array<struct<start:int,end:int,owners:bigint,repos:bigint>>)")
    out = rows.join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left")
    return out.select("doc_id", base.alias("base"), F.when(F.col("added").isNull(), base).otherwise(F.array_sort(F.concat(base, more))).alias("spans"), F.coalesce(counts, none).alias("counts"))


def spelled(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    out = scan(docs)
    counts = [of_kind("base", k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return out.select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def digest_sql() -> str:
    """DuckDB SQL of `scan_digest` with its defaults: the same patterns, positions by sums over pieces and matches."""
    found = " UNION ALL ".join(
        f"""
  SELECT doc_id, source, lang, {kind} AS kind, unnest(range(1, len(m) + 1)) AS i, v, [length(x) FOR x IN m] AS ml, [length(x) FOR x IN string_split_regex(t, p)] AS gl
  FROM (SELECT doc_id, source, lang, t, p, regexp_extract_all(t, p) AS m, regexp_extract_all(t, p, {group}) AS v
        FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t, $${pattern}$$ AS p FROM documents))"""
        for kind, pattern, group in ((0, ASSIGN, 2), (1, ACCESS, 0), (2, HEX, 0))
    )
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    spelled = f"{names}[kind + 1] || ':' || start || ':' || stop"
    return f"""
WITH found AS ({found}
), placed AS (
  SELECT doc_id, source, lang, kind, v[i] AS value, list_sum(gl[1:i]) + coalesce(list_sum(ml[1:i - 1]), 0) AS start, list_sum(gl[1:i]) + list_sum(ml[1:i]) AS stop FROM found
), base AS (
  SELECT doc_id, source, lang, kind, value, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE kind <> 0 OR length(value) >= {ASSIGN_LEAST}
), owned AS (
  SELECT value, CASE WHEN count(DISTINCT row(source)) >= 2 OR count(DISTINCT row(source, lang)) >= 4 THEN 4 ELSE 3 END AS verdict FROM base GROUP BY value
), spans AS (
  SELECT doc_id, kind, start, stop FROM base UNION ALL
  SELECT DISTINCT doc_id, verdict, stop - length(value), stop FROM base JOIN owned USING (value)
), told AS (
  SELECT doc_id, string_agg({spelled}, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg({spelled}, ',' ORDER BY start, kind, stop) AS spans,
         {", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{KINDS[k]}" for k in range(3))}
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS[:3])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN told USING (doc_id)
"""
