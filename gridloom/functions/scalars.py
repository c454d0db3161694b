"""Column expressions: time index, ids, calendar, scaling, geography and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in km, compass codes in order, missing code.
EARTH_KM = 6371.0088
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
MISSING_CODE = 16


def hour_index(ts: str, start: str) -> Column:
    """Whole hours since `start`, independent of the session's time zone."""
    return F.expr(f"cast(timestampdiff(HOUR, timestamp_ntz'{start}', {ts}) as int)")


def hour_timestamp(index: str, start: str) -> Column:
    return F.expr(f"timestampadd(HOUR, {index}, timestamp_ntz'{start}')")


def total_hours(first: str, last: str) -> Column:
    """Hours of a closed interval of hourly timestamps."""
    return F.expr(f"cast(timestampdiff(HOUR, timestamp_ntz'{first}', timestamp_ntz'{last}') + 1 as int)")


def window_bounds(target: Column, horizon: Column, context: int) -> tuple[Column, Column]:
    """First and last hour of the context of a sample; the last is the forecast origin."""
    origin = target - horizon
    return origin - (context - 1), origin


def sample_id(partition: Column, station: Column, stamp: Column, horizon: Column) -> Column:
    return F.concat_ws("|", partition, station.cast("string"), F.date_format(stamp, "yyyyMMddHH"), F.concat(F.lit("h"), horizon.cast("string")))


def parse_sample_id(column: Column) -> dict[str, Column]:
    """Parts of a sample id; a malformed one fails the query."""
    whole = column.rlike(r"^[^|]+\|[^|]+\|\d{10}\|h\d+$")
    checked = F.when(whole, column).otherwise(F.raise_error(F.concat(F.lit("malformed sample id: "), column)).cast("string"))
    parts = F.split(checked, r"\|")
    return {"partition": parts[0], "station": parts[1], "target": F.to_timestamp_ntz(parts[2], F.lit("yyyyMMddHH")), "horizon": F.substring(parts[3], 2, 9).cast("int")}


def cyclic(value: Column, period: Column | float, name: str) -> list[Column]:
    """Sine and cosine of a value on a circle."""
    angle = value * (2 * F.pi()) / (period if isinstance(period, Column) else F.lit(float(period)))
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]


def calendar(stamp: Column) -> list[Column]:
    """Six cyclic channels and three raw ones; the year's length counts leap days."""
    days = F.dayofyear(F.make_date(F.year(stamp), F.lit(12), F.lit(31)))
    return [
        *cyclic(F.hour(stamp), 24, "hour"),
        *cyclic(F.dayofyear(stamp) - 1, days.cast("double"), "doy"),
        *cyclic(F.month(stamp) - 1, 12, "month"),
        F.hour(stamp).alias("hour"), F.dayofyear(stamp).alias("doy"), F.month(stamp).alias("month"),
    ]


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").otherwise("SON")


def robust_scale(x: Column, median: Column, iqr: Column, std: Column) -> Column:
    """(x - median) / IQR, or / std where the IQR is 0; null where both are 0."""
    return (x - median) / F.coalesce(F.nullif(iqr, F.lit(0.0)), F.nullif(std, F.lit(0.0)))


def scale_method(iqr: Column, std: Column) -> Column:
    return F.when(iqr != 0, "median_iqr").when(std != 0, "median_std_zero_iqr_fallback").otherwise("constant")


def scaled_gap_age(age: Column, cap: int = 168) -> Column:
    return age / F.lit(float(cap))


def one_hot(column: Column, values: list, name: str) -> list[Column]:
    return [F.coalesce((column == v).cast("int"), F.lit(0)).alias(f"{name}_{v}") for v in values]


def compass_code(direction: Column) -> Column:
    """0 to 15 in compass order; 16 for anything else."""
    at = F.array_position(F.array(*[F.lit(c) for c in COMPASS]), direction)
    return F.when(direction.isNull() | (at == 0), MISSING_CODE).otherwise(at - 1).cast("int")


def occurred(value: Column) -> Column:
    """Observed and above zero."""
    return (value.isNotNull() & (value > 0)).cast("int")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def rate(count: Column, total: Column, digits: int = 8) -> Column:
    """count / total, 0 where total is 0."""
    return F.round(F.coalesce(F.try_divide(count.cast("double"), total.cast("double")), F.lit(0.0)), digits)


def percent(count: Column, total: Column) -> Column:
    return F.try_divide(count.cast("double") * 100, total.cast("double"))


def receptive_field(kernel: int, dilations: Column, convs: int = 2) -> Column:
    """Steps that a stack of dilated causal convolutions sees."""
    return F.aggregate(dilations, F.lit(1), lambda acc, d: acc + F.lit(convs * (kernel - 1)) * d)


def value_kind(text: Column) -> Column:
    """missing, int, float, nonfinite or text of a raw value."""
    number = F.expr("try_cast(NULL as double)") if text is None else text.try_cast("double")
    return (
        F.when(text.isNull() | (text == "") | (text == "NA"), "missing")
        .when(text.rlike(r"^[+-]?\d+$"), "int")
        .when(number.isNotNull() & (F.isnan(number) | (F.abs(number) == float("inf"))), "nonfinite")
        .when(number.isNotNull(), "float")
        .otherwise("text")
    )


def six(column: Column) -> Column:
    """A float at the border of the engine: 6 decimals."""
    return F.round(column, 6)
