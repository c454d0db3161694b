"""Digests of tables that hold whatever the order of rows, their partitioning, or the engine that adds them up.

A row is the text of its columns in a given order; its SHA-256 gives two numbers of 60 bits, and a table's digest is the
SHA-256 of its row count and the sums of both. Sums are partial before the shuffle, so a table of any size costs one row
a task. Doubles count in steps of 1e-4, since sums of floats depend on the order of rows; `SHIFT` puts the borders of the
steps where means and shares of short numbers don't lie.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL, STEPS, SHIFT = "~", 10_000, 0.3571
#: Numbers are added up in parts of so many bits, as longs, which are far quicker than decimals; 2^43 rows have room.
BITS = 20


def steps_of(x: Column) -> Column:
    """A float as a whole number of steps."""
    return F.floor(x.cast("double") * STEPS + SHIFT).cast("long")


def steps_sql(x: str) -> str:
    return f"CAST(floor({x} * {STEPS} + {SHIFT}) AS BIGINT)"


def row_text(df: DataFrame, columns: list[str]) -> Column:
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        x = F.col(f"`{c}`")
        if kinds[c] in ("double", "float"):
            x = steps_of(x)
        return F.coalesce(x.cast("string"), F.lit(NULL))

    return F.concat_ws("|", *map(text, columns))


def table_digest(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """rows, digest of a table, or of each of its groups by keys."""
    name = F.sha2(row_text(df, columns), 256)
    halves = {n: F.conv(F.substring(name, at, 15), 16, 10).cast("long") for n, at in (("_a", 1), ("_b", 16))}
    parts = [F.sum(F.shiftright(n, BITS * i).bitwiseAND(F.lit((1 << BITS) - 1))).alias(f"{n}{i}") for n in halves for i in range(60 // BITS)]
    sums = df.select(*(keys or []), *[c.alias(n) for n, c in halves.items()]).groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("rows"), *parts)
    whole = [reduce(add, [F.coalesce(F.col(f"{n}{i}"), F.lit(0)).cast("decimal(38,0)") * F.lit(1 << BITS * i).cast("decimal(13,0)") for i in range(60 // BITS)]).cast("decimal(38,0)").cast("string") for n in halves]
    return sums.select(*(keys or []), "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *whole), 256).alias("digest"))


def digest_sql(table: str, columns: list[str], doubles: list[str], keys: list[str] | None = None) -> str:
    """DuckDB: the same digest of a table; doubles name the columns that are floats."""
    parts = [f"coalesce(CAST({steps_sql(c) if c in doubles else c} AS VARCHAR), '{NULL}')" for c in columns]
    by = "".join(f"{k}, " for k in keys or [])
    sums = [f"CAST(coalesce(sum(CAST('0x' || substr(h, {at}, 15) AS BIGINT)), 0) AS VARCHAR)" for at in (1, 16)]
    return f"SELECT {by}count(*) AS rows, sha256(count(*) || ':' || {sums[0]} || ':' || {sums[1]}) AS digest FROM (SELECT {by}sha256({" || '|' || ".join(parts)}) AS h FROM {table}){f' GROUP BY {by[:-2]}' if keys else ''}"
