"""Contracts over sample indexes, splits, sealed hours and runs: audits, guarded accessors, completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import rate
from gridloom.sources.tables import Timeline
from gridloom.sources.work import written


def file_rollup(rows: DataFrame, file: str, kind: str, bad: Column, example: Column, examples: int = 5) -> DataFrame:
    """Per file, and over all (file null): rows, bad rows and their rate, kinds, the first examples of bad rows.

    Examples are the smallest ones: a slice of the sorted smallest by file, found by a rank that stops early.
    """
    totals = rows.groupingSets([[], [F.col(file)]], file).agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad"), F.countDistinct(kind).alias("kinds"))
    order = Window.partitionBy(file).orderBy("_example")
    few = rows.filter(bad).select(file, example.alias("_example")).distinct().withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= examples)
    shown = few.groupBy(F.col(file).alias("_file")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("_example")), lambda x: x.cast("string")), ",").alias("examples"))
    joined = totals.join(shown, F.col(file) == F.col("_file"), "left").drop("_file")
    return joined.withColumn("bad_rate", rate(F.col("bad"), F.col("rows"))).withColumn("examples", F.coalesce("examples", F.lit("")))


def schema_agreement(rows: DataFrame, file: str, kind: str) -> DataFrame:
    """files, distinct_schemas, agree: whether all files hold the same kinds."""
    names = rows.select(file, kind).distinct().groupBy(file).agg(F.array_join(F.sort_array(F.collect_list(kind)), ",").alias("names"))
    return names.agg(F.count(F.lit(1)).alias("files"), F.countDistinct("names").alias("distinct_schemas")).withColumn("agree", F.col("distinct_schemas") <= 1)


def index_violations(index: DataFrame, timeline: Timeline, context: int, forbidden: tuple[str, ...] = ("value", "actual")) -> DataFrame:
    """Rows, ids, and how many rows break a rule of a sample index; all but the first two must be 0."""
    return index.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("sample_id").alias("ids"),
        F.count_if(F.col("origin_idx") != F.col("target_idx") - F.col("horizon")).alias("bad_origin"),
        F.count_if(~F.col("target_idx").between(0, timeline.hours - 1)).alias("out_of_bounds"),
        F.count_if((F.col("context_start") < 0) | (F.col("origin_idx") - F.col("context_start") + 1 != context)).alias("bad_context"),
        F.lit(sum(c in forbidden for c in index.columns)).cast("long").alias("value_columns"),
    )


def checked_index(index: DataFrame, timeline: Timeline, context: int) -> DataFrame:
    """The index as it is, or an error that tells which rule is broken."""
    found = index_violations(index, timeline, context).first().asDict()
    rows, ids = found.pop("rows"), found.pop("ids")
    if rows != ids or any(found.values()):
        raise ValueError(f"sample index: {rows} rows, {ids} ids, {found}")
    return index


def window_of(samples: DataFrame, panel: DataFrame, columns: list[str], context: int) -> DataFrame:
    """`samples` with `steps`: the context of each sample up to its origin, by one window per series and an equi-join."""
    last = Window.partitionBy("station").orderBy("hour_idx").rowsBetween(-(context - 1), 0)
    steps = F.when(F.count(F.lit(1)).over(last) == context, F.collect_list(F.struct(*columns)).over(last))
    held = panel.select(F.col("station").alias("_s"), F.col("hour_idx").alias("_h"), steps.alias("steps"))
    return samples.join(held, (F.col("station") == F.col("_s")) & (F.col("origin_idx") == F.col("_h"))).drop("_s", "_h")


def guarded_accessors(samples: DataFrame, filled: DataFrame, context: int) -> DataFrame:
    """native_at, source_at, observed_in_window, filled_mean of each sample, none of them after its origin."""
    last = Window.partitionBy("station").orderBy("hour_idx").rowsBetween(-(context - 1), 0)
    held = filled.select(
        F.col("station").alias("_s"), F.col("hour_idx").alias("_h"), F.when(F.col("observed"), F.col("value")).alias("native_at"), F.col("source").alias("source_at"),
        F.count_if(F.col("observed")).over(last).alias("observed_in_window"), F.avg("filled").over(last).alias("filled_mean"),
    )
    return samples.join(held, (F.col("station") == F.col("_s")) & (F.col("origin_idx") == F.col("_h"))).drop("_s", "_h")


def masked_after(panel: DataFrame, ceiling: int, value: str, code: str, sentinel: int = -99) -> DataFrame:
    """Values after the ceiling become null and codes the sentinel; `usable` is false where a feature isn't finite."""
    open_ = F.col("hour_idx") <= ceiling
    rows = panel.withColumn(value, F.when(open_, F.col(value))).withColumn(code, F.when(open_, F.col(code)).otherwise(F.lit(sentinel)))
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return rows.withColumn("usable", finite & (F.col(code) != sentinel))


def sealed_partitions(panel: DataFrame, timeline: Timeline, ceiling: int) -> DataFrame:
    """Hours and observed hours by partition; `sealed` where a partition ends after the ceiling, and then none is told."""
    rows = panel.groupBy(timeline.partition(F.col("hour_idx")).alias("partition")).agg(F.count(F.lit(1)).alias("hours"), F.count_if("observed").alias("_seen"), F.max("hour_idx").alias("last_hour"))
    sealed = F.col("last_hour") > ceiling
    return rows.select("partition", "hours", "last_hour", sealed.alias("sealed"), F.when(~sealed, F.col("_seen")).alias("observed"))


def internal_split(train: DataFrame, core_end: int) -> DataFrame:
    """`train` with `part`: core up to an hour of the target, tuning after it."""
    return train.withColumn("part", F.when(F.col("target_idx") <= core_end, "core").otherwise("tuning"))


def split_check(parts: DataFrame, whole: DataFrame, key: str, part: str = "part") -> DataFrame:
    """parts, twice (keys in several parts), missing (keys in no part), foreign (keys not in the whole): a disjoint cover has 0, 0, 0."""
    own = parts.groupBy(key).agg(F.countDistinct(part).alias("_parts"))
    met = whole.select(key).distinct().withColumn("_whole", F.lit(True)).join(own, key, "full_outer")
    return met.agg(F.max("_parts").alias("most_parts"), F.count_if(F.col("_parts") > 1).alias("twice"), F.count_if(F.col("_parts").isNull()).alias("missing"), F.count_if(F.col("_whole").isNull()).alias("foreign"))


def numbered(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """`rows` with `position` from 0 in the order of groups and then `order`.

    Rows are dealt into ranges of that order, whose bounds Spark samples, and written; counts of the ranges give each its
    first position, and a task sorts one range. Rows of equal order take any of their positions.
    """
    keys = [*groups, *order]
    dealt = written(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy(F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.select("_r", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_r")) - F.col("_n")).alias("_first"))  # one row a range
    here = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    return dealt.withColumn("_here", here).join(first, F.col("_range") == F.col("_r")).withColumn("position", (F.col("_first") + F.col("_here")).cast("long")).drop("_here", "_first", "_range", "_r")


def groups_with(rows: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    """All rows of the groups in which some row is a hit."""
    return rows.join(rows.filter(hit).select(*keys).distinct(), keys, "left_semi")


def enriched(computed: DataFrame, frozen: DataFrame, own: str) -> DataFrame:
    """Rows of the own model as computed, those of the others as they were frozen, with `origin`."""
    fresh = computed.filter(F.col("model") == own).withColumn("origin", F.lit("computed"))
    return fresh.unionByName(frozen.filter(F.col("model") != own).withColumn("origin", F.lit("frozen")))


def completed(runs: DataFrame, first: DataFrame, later: DataFrame, key: str, column: str, from_first: Column) -> DataFrame:
    """`runs` with a column from one of two tables, chosen by each row; null where the chosen table has none."""
    a, b = first.select(F.col(key).alias("_a"), F.col(column).alias("_from_a")), later.select(F.col(key).alias("_b"), F.col(column).alias("_from_b"))
    rows = runs.join(a, F.col(key) == F.col("_a"), "left").join(b, F.col(key) == F.col("_b"), "left")
    return rows.withColumn(column, F.when(from_first, F.col("_from_a")).otherwise(F.col("_from_b"))).drop("_a", "_b", "_from_a", "_from_b")


def set_difference(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """matched, missing, extra between two sets of keys; equal sets have no missing and no extra."""
    a = found.select(*keys).distinct().withColumn("_f", F.lit(True))
    b = expected.select(*keys).distinct().withColumn("_e", F.lit(True))
    met = a.join(b, keys, "full_outer")
    return met.agg(F.count_if(F.col("_f") & F.col("_e")).alias("matched"), F.count_if(F.col("_f").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("extra"))


def only_confirmed(rows: DataFrame, column: str, confirmed: list) -> DataFrame:
    """`rows`, or an error where a value is not on the list."""
    strange = [r[0] for r in rows.filter(~F.col(column).isin(confirmed)).select(column).distinct().limit(5).collect()]
    if strange:
        raise ValueError(f"{column} holds {strange}, which nobody confirmed")
    return rows


def importance(gains: DataFrame, name: str, gain: str) -> DataFrame:
    """place, name, gain, share: features by gain, the name deciding ties. There is one row a feature."""
    total = gains.agg(F.sum(gain).alias("_total"))
    place = F.row_number().over(Window.orderBy(F.col(gain).desc(), name))
    return gains.join(F.broadcast(total)).select(place.alias("place"), name, gain, F.try_divide(F.col(gain), F.col("_total")).alias("share"))  # one row is broadcast
