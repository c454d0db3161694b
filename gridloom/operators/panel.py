"""Dense hourly panels: grid, masks, gap age, causal fills, scaling statistics, fill audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.aggregates import quantile
from gridloom.functions.scalars import MISSING_CODE, robust_scale, scale_method
from gridloom.operators.stats import quantiles
from gridloom.sources.work import written

SERIES = ("station", "variable")
#: Rows of a dense panel that a task makes, about.
TASK_ROWS = 2_000_000


def grid(observations: DataFrame, hours: int, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Every hour of every series, with null where nothing was observed."""
    series = observations.select(*keys).distinct()
    dense = series.withColumn("hour_idx", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
    return dense.join(observations, [*keys, "hour_idx"], "left").withColumn("observed", F.col("value").isNotNull())


def train_medians(panel: DataFrame, train_end: int, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Median of observed training values of each series, 0 where there is none."""
    value = F.when(F.col("hour_idx") <= train_end, F.col("value"))
    return panel.groupBy(*keys).agg(F.coalesce(quantile(value, 0.5), F.lit(0.0)).alias("train_median"))


def carried(value: Column, keys: tuple[str, ...], reach: int) -> Column:
    """The latest value at most `reach` hours old."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("hour_idx").rangeBetween(-reach, 0))


def causal_fill(panel: DataFrame, medians: DataFrame, reach: int = 6, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Adds `filled` and `source`: 0 observed, 1 carried at most `reach` hours, 2 the training median."""
    held = panel.withColumn("_held", carried(F.col("value"), keys, reach)).join(medians, list(keys))
    source = F.when(F.col("value").isNotNull(), 0).when(F.col("_held").isNotNull(), 1).otherwise(2)
    return held.withColumn("filled", F.coalesce("_held", "train_median")).withColumn("source", source).drop("_held", "train_median")


def tasks_of(observations: DataFrame, hours: int, keys: tuple[str, ...] = SERIES) -> int:
    """Tasks for the dense panel of the observed series: counted, because a few observations become many hours."""
    return max(observations.sparkSession.sparkContext.defaultParallelism, -(-observations.select(*keys).distinct().count() * hours // TASK_ROWS))


def filled_series(observations: DataFrame, hours: int, train_end: int, tasks: int, reach: int = 6, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """What `grid` and `causal_fill` by `train_medians` give, made in the tasks that hold the observations of a series.

    Each observation makes the hours up to the next one, the first also those before it. So observations are exchanged,
    once and by series, and dense rows are neither exchanged nor joined. Series with a null key have no rows, as in those joins.
    """
    by, h = Window.partitionBy(*keys), F.col("hour_idx")
    order = by.orderBy("hour_idx")
    median = F.coalesce(quantile(F.when(h <= train_end, F.col("value")), 0.5).over(by), F.lit(0.0))
    held = F.last(F.when(F.col("value").isNotNull(), F.struct(h.alias("at"), "value")), ignorenulls=True).over(order)
    made = F.sequence(F.when(F.row_number().over(order) == 1, 0).otherwise(h), F.coalesce(F.lead(h).over(order) - 1, F.lit(hours - 1)))
    rows = observations.dropna(subset=list(keys)).repartition(tasks, *keys).select(*keys, median.alias("_median"), held.alias("_held"), made.alias("_made"))
    rows = rows.select(*keys, F.explode("_made").alias("hour_idx"), "_median", "_held")
    age = h - F.col("_held.at")
    carried_ = F.when(age.between(0, reach), F.col("_held.value"))
    return rows.select(
        *keys, "hour_idx", F.when(age == 0, F.col("_held.value")).alias("value"), F.coalesce(age == 0, F.lit(False)).alias("observed"),
        F.coalesce(carried_, "_median").alias("filled"), F.when(age == 0, 0).when(carried_.isNotNull(), 1).otherwise(2).alias("source"),
    )


def categorical_fill(panel: DataFrame, code: str, reach: int = 6, keys: tuple[str, ...] = ("station",), missing: int = MISSING_CODE) -> DataFrame:
    """Adds `filled_code` and `source`; a code that can't be carried is the missing one."""
    held = carried(F.col(code), keys, reach)
    source = F.when(F.col(code).isNotNull(), 0).when(held.isNotNull(), 1).otherwise(2)
    return panel.withColumn("filled_code", F.coalesce(held, F.lit(missing))).withColumn("source", source)


def gap_age(panel: DataFrame, cap: int = 168, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Adds hours since the last observation: 0 where observed, at most `cap`, `cap` where never observed."""
    window = Window.partitionBy(*keys).orderBy("hour_idx").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("value").isNotNull(), F.col("hour_idx"))).over(window)
    return panel.withColumn("gap_age", F.coalesce(F.least(F.col("hour_idx") - last, F.lit(cap)), F.lit(cap)))


def fill_audit(filled: DataFrame, partition: Column) -> DataFrame:
    """Hours by fill source and the largest gap age, by partition and series."""
    kinds = [F.count_if(F.col("source") == k).alias(n) for k, n in enumerate(("raw_observed", "causal_ffill", "median_fallback"))]
    return filled.groupBy(partition.alias("partition"), *SERIES).agg(*kinds, F.max("gap_age").alias("max_gap_age"))


def scaling_statistics(panel: DataFrame, train_end: int) -> DataFrame:
    """n, median, quartiles, IQR, mean and std of training values: pooled by variable, and by variable and station.

    A series has a value an hour at most, so a task can hold it; pooled quantiles come by counting, so no task holds a
    variable. Quantiles leave NaN out.
    """
    v, quarters = F.col("value"), {"median": 0.5, "p25": 0.25, "p75": 0.75}
    train = written(panel.filter((F.col("hour_idx") <= train_end) & v.isNotNull()).select("variable", "station", v), "train-values")
    number = F.when(~F.isnan(v.cast("double")), v)
    moments = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")]
    pooled = train.groupBy("variable").agg(*moments).join(quantiles(train, "value", ["variable"], quarters), "variable", "left")
    each = train.groupBy("variable", "station").agg(*moments, *[quantile(number, p).alias(n) for n, p in quarters.items()])
    both = each.unionByName(pooled.withColumn("station", F.lit(None).cast(train.schema["station"].dataType)))
    return both.select("variable", "station", "n", *quarters, (F.col("p75") - F.col("p25")).alias("iqr"), "mean", "std")


def scaled(filled: DataFrame, statistics: DataFrame) -> DataFrame:
    """Adds `scaled` and `method` from each variable's pooled training statistics."""
    pooled = statistics.filter(F.col("station").isNull()).select("variable", "median", "iqr", "std")
    rows = filled.join(pooled, "variable")
    return rows.withColumn("scaled", robust_scale(F.col("filled"), F.col("median"), F.col("iqr"), F.col("std"))).withColumn("method", scale_method(F.col("iqr"), F.col("std"))).drop("median", "iqr", "std")
