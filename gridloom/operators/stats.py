"""Distributions, correlation, autocorrelation, ranks, regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.aggregates import correlation, skew
from gridloom.sources.work import written

#: Distinct values of a bucket, about; one task sorts a bucket.
BUCKET_VALUES = 50_000
#: Stations whose pairs an operator may make.
MOST_STATIONS = 2_000


def few_stations(panel: DataFrame, most: int = MOST_STATIONS) -> None:
    """An error where pairs of all stations would be more than a job should make."""
    if panel.select("station").distinct().limit(most + 1).count() > most:
        raise ValueError(f"pairs of all stations are for {most} stations at most")


def ranged(counted: DataFrame, x: str, keys: list[str], ranges: int) -> DataFrame:
    """`counted` with the number `_range` of the range of (keys, x) that each row lies in."""
    return counted.repartitionByRange(ranges, *keys, x).withColumn("_range", F.spark_partition_id())


def running_counts(rows: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """keys, x, n, before, rows: each distinct value, how often it comes, how many rows of its group are smaller, and all rows.

    Equal values are counted first, and the counts written. Where they are more than a task should sort, they are dealt
    into ranges of (keys, x) whose bounds Spark samples from the values themselves, so outliers and heavy tails leave the
    ranges as full as any others; sums by range give each its place. Nulls come first, NaN last.
    """
    counted = written(rows.select(*keys, F.col(x)).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n")), "stats-counts")
    ranges = -(-counted.count() // BUCKET_VALUES)
    if ranges <= 1:
        group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        return counted.select(*keys, x, "n", (F.sum("n").over(group.orderBy(x)) - F.col("n")).alias("before"), F.sum("n").over(group).alias("rows"))
    dealt = written(ranged(counted, x, keys, ranges), "stats-ranges")
    sums = dealt.groupBy(*keys, "_range").agg(F.sum("n").alias("_n"))  # one row for each range of a group
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sums = sums.select(*[F.col(k).alias(f"_{k}_") for k in keys], F.col("_range").alias("_r"), (F.sum("_n").over(group.orderBy("_range")) - F.col("_n")).alias("_first"), F.sum("_n").over(group).alias("rows"))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}_"))
    here = F.sum("n").over(Window.partitionBy(*keys, "_range").orderBy(x)) - F.col("n")
    placed = dealt.withColumn("_here", here).join(sums, same)
    return placed.select(*keys, x, "n", (F.col("_first") + F.col("_here")).alias("before"), "rows")


def quantiles(rows: DataFrame, x: str, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """keys and a column for each named share: exact quantiles with linear interpolation, by counting instead of holding a group."""
    counts = running_counts(rows.filter(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))), x, keys)
    value = F.col(x).cast("double")

    def at(rank):
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), value))

    out = []
    for name, p in shares.items():
        place = F.lit(p) * (F.col("rows") - 1)
        low = F.floor(place)
        out.append((at(low) + (at(F.ceil(place)) - at(low)) * F.max(place - low)).alias(name))
    return counts.groupBy(*keys).agg(*out)


def describe(rows: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """Moments and exact quantiles of finite values."""
    v = F.col(x)
    ok = rows.filter(v.isNotNull() & ~F.isnan(v))
    ok = written(ok.select(*keys, x), "stats-values")
    moments = ok.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), skew(v).alias("skewness"))
    shares = {f"p{int(p * 100):02d}": p for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)}
    found = quantiles(ok, x, keys, shares).select(*[F.col(k).alias(f"_{k}_") for k in keys], *shares)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}_"))
    return moments.join(found, same).select(*keys, "n", "mean", "std", "min", "max", *shares, "skewness")


def thresholds(rows: DataFrame, x: str, station: str, p: float = 0.95) -> DataFrame:
    """A quantile over all rows (station null) and by station."""
    counts = rows.groupingSets([[], [F.col(station)]], station).agg(F.count(x).alias("n"))
    kind = rows.schema[station].dataType
    pooled = quantiles(rows, x, [], {"threshold": p}).select(F.lit(None).cast(kind).alias("_s"), "threshold")
    each = quantiles(rows, x, [station], {"threshold": p}).select(F.col(station).alias("_s"), "threshold")
    return counts.join(pooled.union(each), F.col(station).eqNullSafe(F.col("_s")), "left").select(station, "n", "threshold")


def histogram(rows: DataFrame, x: str, bins: int = 60, top: float = 0.99) -> DataFrame:
    """Equal bins from 0 to a quantile, the last one closed; what lies above goes, empty bins stay."""
    high = quantiles(rows, x, [], {"high": top})
    at = F.least(F.floor(F.col(x) / F.col("high") * bins), F.lit(bins - 1)).cast("int")
    counted = rows.select(x).join(F.broadcast(high)).filter((F.col(x) >= 0) & (F.col(x) <= F.col("high"))).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))  # one row is broadcast
    return rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").fillna(0, ["count"])


def autocorrelation(panel: DataFrame, x: str, lags: tuple[int, ...], keys: tuple[str, ...], least: int = 30) -> DataFrame:
    """r of a series with itself some hours before, where both are there. A lag is a row offset in a dense grid."""
    window = Window.partitionBy(*keys).orderBy("hour_idx")
    wide = panel.select(*keys, F.col(x).alias("x"), *[F.lag(x, k).over(window).alias(f"y{k}") for k in lags])
    pairs = wide.select(*keys, "x", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"y{k}").alias("y")) for k in lags])).alias("p"))
    both = pairs.filter(F.col("x").isNotNull() & F.col("p.y").isNotNull())
    return both.groupBy(*keys, F.col("p.lag").alias("lag")).agg(F.count(F.lit(1)).alias("pairs"), correlation(F.col("x"), F.col("p.y"), least).alias("r"))


def spread(rows: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """mean, median, min, max, quartiles and IQR over the groups' members, of any number: quantiles come by counting."""
    v = F.col(x)
    kept = written(rows.select(*keys, v), "stats-spread")
    moments = kept.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    found = quantiles(kept, x, keys, {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return moments.join(found, keys, "left").select(*keys, "n", "mean", "median", "min", "max", "q25", "q75", (F.col("q75") - F.col("q25")).alias("iqr"))


def station_correlation(panel: DataFrame, x: str = "value") -> DataFrame:
    """r of every ordered pair of stations over hours that both have; pairs meet by hour, and stations are counted first."""
    few_stations(panel)
    a = panel.filter(F.col(x).isNotNull()).select("hour_idx", F.col("station").alias("a"), F.col(x).alias("x"))
    b = a.select("hour_idx", F.col("a").alias("b"), F.col("x").alias("y"))
    return a.join(b, "hour_idx").groupBy("a", "b").agg(F.count(F.lit(1)).alias("pairs"), correlation(F.col("x"), F.col("y")).alias("r"))


def ranked(rows: DataFrame, ranks: dict[str, str], keys: list[str]) -> DataFrame:
    """`rows` with a rank in their group for each column, ties averaged; ranks: names by column.

    Ranks belong to distinct values and come back by an equi-join for each column; rows of a long plan had better be
    written before.
    """
    base = rows
    for x, name in ranks.items():
        counts = running_counts(base, x, keys).select(*[F.col(k).alias(f"_{k}_") for k in keys], F.col(x).alias("_x"), (F.col("before") + (F.col("n") + 1) / 2).alias(name))
        same = F.col(x).eqNullSafe(F.col("_x"))
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}_"))
        rows = rows.join(counts, same).drop("_x", *[f"_{k}_" for k in keys])
    return rows


def spearman(rows: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Rank correlation within groups, ties averaged."""
    found = ranked(written(rows.select(*keys, x, y), "stats-rows"), {x: "rx", y: "ry"}, keys)
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("rx"), F.col("ry")).alias("rho"))


def least_squares(rows: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    fit = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.try_divide(F.covar_pop(x, y), F.nullif(F.var_pop(x), F.lit(0.0))).alias("slope"))
    return fit.select(*keys, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def quartile_bins(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Means of y in quartile bins of x; a value on a border belongs to the lower bin."""
    q = quantiles(rows, x, [], {f"q{i}": p for i, p in enumerate((0.25, 0.5, 0.75))})
    at = F.when(F.col(x) <= F.col("q0"), 0).when(F.col(x) <= F.col("q1"), 1).when(F.col(x) <= F.col("q2"), 2).otherwise(3)
    return rows.join(F.broadcast(q)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"))  # one row is broadcast
