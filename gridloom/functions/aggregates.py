"""Aggregate expressions: error metrics, exact quantiles, moments and guarded correlation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mae(residual: Column) -> Column:
    return F.avg(F.abs(residual))


def rmse(residual: Column) -> Column:
    return F.sqrt(F.avg(residual * residual))


def r2(actual: Column, residual: Column) -> Column:
    """1 - SSE / SST; null where the actuals are constant or few."""
    total = F.var_pop(actual) * F.count(actual)
    return 1 - F.try_divide(F.sum(residual * residual), F.nullif(total, F.lit(0.0)))


def quantile(x: Column, p: float) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(x, p)


def share(condition: Column) -> Column:
    """Percent of rows where the condition holds."""
    return F.try_divide(F.count_if(condition).cast("double") * 100, F.count(F.lit(1)).cast("double"))


def correlation(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson's r of pairs without nulls; null for fewer than `least` pairs or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.when(F.count(x) >= least, F.try_divide(F.covar_pop(x, y), F.nullif(spread, F.lit(0.0))))


def skew(x: Column) -> Column:
    """Population skewness; null for constant values."""
    m, v = F.avg(x), F.var_pop(x)
    third = F.avg(x * x * x) - 3 * m * F.avg(x * x) + 2 * m * m * m
    return F.when(v > 0, third / F.pow(v, 1.5))


def error_summary(actual: str = "actual", residual: str = "residual") -> list[Column]:
    """n, mae, rmse, mean_residual, underprediction_pct, r2."""
    a, r = F.col(actual), F.col(residual)
    return [F.count(F.lit(1)).alias("n"), mae(r).alias("mae"), rmse(r).alias("rmse"), F.avg(r).alias("mean_residual"), share(r > 0).alias("underprediction_pct"), r2(a, r).alias("r2")]


def percent_of(condition: Column, base: Column) -> Column:
    """Percent of the rows of `base` where the condition holds; null without such rows."""
    return F.try_divide(F.count_if(condition & base).cast("double") * 100, F.count_if(base).cast("double"))
