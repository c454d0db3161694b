"""Windowed features: lags, trailing statistics, mask fractions, contexts. All share one window per series."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.functions.digests import steps_of
from gridloom.operators.stats import few_stations

LAGS, SPANS, MASK_SPANS = (0, 1, 2, 3, 6, 12, 24, 47), (3, 6, 12, 24, 48), (6, 24, 48)


def series(keys: tuple[str, ...] = ("station",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("hour_idx")


def lags(x: str, steps: tuple[int, ...] = LAGS, keys: tuple[str, ...] = ("station",)) -> list[Column]:
    return [F.lag(x, k).over(series(keys)).alias(f"{x}_lag{k}") if k else F.col(x).alias(f"{x}_lag0") for k in steps]


def trailing(x: str, spans: tuple[int, ...] = SPANS, keys: tuple[str, ...] = ("station",)) -> list[Column]:
    """mean, population std, min and max of the last hours; null until the span is full."""
    out = []
    for n in spans:
        window = series(keys).rowsBetween(-(n - 1), 0)
        whole = F.count(x).over(window) == n
        for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max)):
            out.append(F.when(whole, f(x).over(window)).alias(f"{x}_{name}{n}"))
    return out


def mask_fractions(observed: str, spans: tuple[int, ...] = MASK_SPANS, keys: tuple[str, ...] = ("station",)) -> list[Column]:
    """Share of observed hours in the last hours; null until the span is full."""
    out = []
    for n in spans:
        window = series(keys).rowsBetween(-(n - 1), 0)
        seen = F.col(observed).cast("int").cast("double")
        out.append(F.when(F.count(F.lit(1)).over(window) == n, F.avg(seen).over(window)).alias(f"{observed}_share{n}"))
    return out


def rolled(rows: DataFrame, x: str, observed: str, spans: tuple[int, ...] = SPANS, keys: tuple[str, ...] = ("station",)) -> DataFrame:
    """`rows` with the columns of `trailing` of `x` and of `mask_fractions` of `observed`, which has no nulls, for each span.

    A span is a multiple of the one before it, and its statistics come from a few of that one's, one after the other. So
    an hour costs the same whatever the spans are, where a window's frame visits each hour of each span. Squares are of
    differences between sums, so nothing cancels out.
    """
    held, w = {"sum": x, "min": x, "max": x, "seen": observed}, 1
    own = kept = rows.columns
    for n in spans:
        k, rest = divmod(n, w)
        if rest or k < 2:
            raise ValueError(f"span {n} is no multiple of {w}")
        parts = {c: [c, *[f"_{c}_back{i}" for i in range(1, k)]] for c in dict.fromkeys(held.values())}
        rows = rows.select("*", *[F.lag(c, i * w).over(series(keys)).alias(p) for c, ps in parts.items() for i, p in enumerate(ps) if i])
        at = {name: [F.col(p) for p in parts[c]] for name, c in held.items()}
        at |= {"sum": [c.cast("double") for c in at["sum"]], "seen": [c.cast("int").cast("double") for c in at["seen"]]}
        total, between = reduce(add, at["sum"]), reduce(add, [(a - b) * (a - b) for a, b in combinations(at["sum"], 2)])
        made = {"sum": total, "m2": reduce(add, at.get("m2", []), between / float(n)), "min": F.when(total.isNotNull(), F.least(*at["min"])), "max": F.when(total.isNotNull(), F.greatest(*at["max"])), "seen": reduce(add, at["seen"])}
        held, w = {name: f"_{name}{n}" for name in made}, n
        rows = rows.select(*kept, *[c.alias(held[name]) for name, c in made.items()])
        kept = rows.columns
    out = [c for n in spans for c in ((F.col(f"_sum{n}") / n).alias(f"{x}_mean{n}"), F.sqrt(F.col(f"_m2{n}") / n).alias(f"{x}_std{n}"), F.col(f"_min{n}").alias(f"{x}_min{n}"), F.col(f"_max{n}").alias(f"{x}_max{n}"))]
    shares = [(F.col(f"_seen{n}") / n).alias(f"{observed}_share{n}") for n in spans]
    return rows.select(*own, *out, *shares)


def context(columns: list[str], hours: int = 48, keys: tuple[str, ...] = ("station",)) -> Column:
    """The last hours as an array of structs, oldest first; null until it is complete."""
    window = series(keys).rowsBetween(-(hours - 1), 0)
    steps = F.collect_list(F.struct(*columns)).over(window)  # structs keep nulls in their places
    return F.when(F.count(F.lit(1)).over(window) == hours, steps)


def neighbour_context(panel: DataFrame, columns: list[str], hours: int = 48) -> DataFrame:
    """station, hour_idx, neighbours: contexts of all other stations at the same hour, by station; stations are counted first."""
    few_stations(panel)
    own = panel.select("station", "hour_idx", context(columns, hours).alias("steps"))
    other = own.select(F.col("station").alias("_station"), F.col("hour_idx").alias("_hour"), F.col("steps").alias("_steps")).filter(F.col("_steps").isNotNull())
    pairs = own.join(other, (F.col("hour_idx") == F.col("_hour")) & (F.col("station") != F.col("_station")))
    return pairs.groupBy("station", "hour_idx").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_station", "_steps")))).alias("neighbours"))


#: Information regimes: which channels a model may see, each holding those before it.
REGIMES = {"R0": ["calendar"], "R1": ["calendar", "target"], "R2": ["calendar", "target", "others"], "R3": ["calendar", "target", "others", "neighbours"]}
CYCLES = ["hour_sin", "hour_cos", "doy_sin", "doy_cos", "month_sin", "month_cos"]


def channels(regime: str, target: str, others: list[str]) -> list[str]:
    return ([target] if "target" in REGIMES[regime] else []) + (others if "others" in REGIMES[regime] else [])


def feature_names(regime: str, target: str, others: list[str]) -> list[str]:
    """Columns of the wide feature matrix of a regime, in order."""
    names = [*CYCLES]
    for x in channels(regime, target, others):
        names += [f"{x}_lag{k}" for k in LAGS] + [f"{x}_{s}{n}" for n in SPANS for s in ("mean", "std", "min", "max")]
    return names


def feature_matrix(wide: DataFrame, regime: str, target: str, others: list[str], calendar: list[Column]) -> DataFrame:
    """station, hour_idx and the columns of `feature_names`, in one projection over one window."""
    made = [c for x in channels(regime, target, others) for c in (*lags(x), *trailing(x))]
    return wide.select("station", "hour_idx", *calendar, *made).select("station", "hour_idx", *[F.col(f"`{c}`") for c in feature_names(regime, target, others)])


def neighbour_names(target: str, ranks: int) -> list[str]:
    """Columns of the nearest stations, by rank of distance."""
    return [f"near{r}_{n}" for r in range(1, ranks + 1) for n in (*[f"{target}_lag{k}" for k in LAGS], "observed_lag0", "gap_age")]


def sample_names(regime: str, target: str, others: list[str], stations: int, codes: int, rain: str | None = None, ranks: int = 0) -> list[str]:
    """Columns of the matrix of samples: values, masks, gap ages, an occurrence flag and its trailing means, one-hots of
    code and station, calendar of origin and target, and in R3 the nearest stations."""
    own = channels(regime, target, others)
    names = feature_names(regime, target, others)[len(CYCLES) :]
    names += [n for x in own for n in (f"{x}_observed_lag0", *[f"{x}_observed_share{k}" for k in MASK_SPANS])] + [f"{x}_gap_age" for x in own]
    names += [f"{rain}_occurred_lag0", *[f"{rain}_occurred_mean{n}" for n in SPANS]] if rain else []
    names += [f"code_{k}" for k in range(codes)] + [f"station_{s}" for s in range(stations)] + [f"{at}_{c}" for at in ("origin", "target") for c in CYCLES]
    return names + (neighbour_names(target, ranks) if "neighbours" in REGIMES[regime] else [])


def neighbour_columns(wide: DataFrame, near: DataFrame, target: str, ranks: int) -> DataFrame:
    """station, origin_idx and the columns of `neighbour_names`: target histories of the nearest stations at the same hour.

    near: place, rank, neighbour, with at most `ranks` rows a place; a place with fewer has nulls.
    """
    held = wide.select(F.col("station").alias("_n"), F.col("hour_idx").alias("origin_idx"), *lags(target), F.col(f"{target}_observed").cast("int").alias("observed_lag0"), F.col(f"{target}_gap_age").alias("gap_age"))
    met = near.filter(F.col("rank") <= ranks).select(F.col("place").alias("station"), "rank", F.col("neighbour").alias("_n")).join(held, "_n")
    names = held.columns[2:]
    spread = met.groupBy("station", "origin_idx").pivot("rank", list(range(1, ranks + 1))).agg(*[F.first(n).alias(n) for n in names])
    return spread.withColumnsRenamed({f"{r}_{n}": f"near{r}_{n}" for r in range(1, ranks + 1) for n in names})


def sample_matrix(wide: DataFrame, samples: DataFrame, regime: str, target: str, others: list[str], stations: int, codes: int, start: str, rain: str | None = None, near: DataFrame | None = None, ranks: int = 0) -> DataFrame:
    """station, horizon, target_idx, origin_idx and the columns of `sample_names` as they stand at each sample's origin.

    wide: station, hour_idx, code, and for each channel x its filled x, x_observed and x_gap_age; `rain`_occurred.
    near: place, rank, neighbour, for R3.
    """
    own = channels(regime, target, others)
    made = [c for x in own for c in (*lags(x), *trailing(x), F.col(f"{x}_observed").cast("int").alias(f"{x}_observed_lag0"), *mask_fractions(f"{x}_observed"), F.col(f"{x}_gap_age"))]
    if rain:
        wet = F.col(f"{rain}_occurred").cast("double")
        made.append(F.col(f"{rain}_occurred").alias(f"{rain}_occurred_lag0"))
        for n in SPANS:
            window = series().rowsBetween(-(n - 1), 0)
            made.append(F.when(F.count(F.lit(1)).over(window) == n, F.avg(wet).over(window)).alias(f"{rain}_occurred_mean{n}"))
    at_origin = wide.select("station", F.col("hour_idx").alias("origin_idx"), *scalars.one_hot(F.col("code"), list(range(codes)), "code"), *made)
    stamps = [c.alias(f"{at}_{n}") for at in ("origin", "target") for n, c in zip(CYCLES, scalars.calendar(scalars.hour_timestamp(f"{at}_idx", start)), strict=False)]
    rows = samples.select("station", "horizon", "target_idx", "origin_idx", *scalars.one_hot(F.col("station"), list(range(stations)), "station"), *stamps)
    rows = rows.join(at_origin, ["station", "origin_idx"])
    if "neighbours" in REGIMES[regime]:
        rows = rows.join(neighbour_columns(wide, near, target, ranks), ["station", "origin_idx"], "left")
    return rows.select("station", "horizon", "target_idx", "origin_idx", *sample_names(regime, target, others, stations, codes, rain, ranks))


def by_regime(matrix: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """`regime` and the columns of `matrix`, once for each regime of `names`, which maps it to its columns of the matrix.

    Regimes come in order, each with the columns of those before it; columns that a regime lacks are null, columns in
    no regime are kept. One matrix of the widest regime serves all of them, so windows and joins run once.
    """
    order = list(names)
    for before, after in zip(order, order[1:], strict=False):
        if not set(names[before]) <= set(names[after]):
            raise ValueError(f"{after} lacks columns of {before}")
    lowest = {c: i for i in reversed(range(len(order))) for c in names[order[i]]}
    rows = matrix.select("*", F.posexplode(F.array(*map(F.lit, order))).alias("_level", "regime"))
    kept = [F.when(F.col("_level") >= lowest[c], F.col(f"`{c}`")).alias(c) if lowest.get(c) else F.col(f"`{c}`") for c in matrix.columns]
    return rows.select("regime", *kept)


def dynamic_names(numeric: list[str], pollutants: list[str], rain: str, codes: list[str]) -> list[str]:
    """Channels of a sequence, in order: values, masks, gap ages of pollutants, the occurrence flag, one-hots of codes."""
    return [f"value:{x}" for x in numeric] + [f"mask:{x}" for x in numeric] + [f"gap_age_scaled:{x}" for x in pollutants] + [f"{rain}_occurred"] + [f"wd_is_{c}" for c in codes]


def static_names(stations: list[str], horizons: tuple[int, ...]) -> list[str]:
    """Channels of a sample that don't change over its context, in order."""
    return [f"station_is_{s}" for s in stations] + [f"horizon_is_{h}h" for h in horizons] + [f"{at}_{c}" for at in ("origin", "target") for c in CYCLES]


def dynamic_vector(numeric: list[str], pollutants: list[str], rain: str, codes: int, cap: int = 168) -> Column:
    """The channels of `dynamic_names` at one hour as an array of floats; values are scaled ones, x_scaled."""
    values = [F.col(f"{x}_scaled") for x in numeric] + [F.col(f"{x}_observed").cast("int") for x in numeric] + [F.col(f"{x}_gap_age") / float(cap) for x in pollutants]
    return F.array(*[c.cast("float") for c in (*values, F.col(f"{rain}_occurred"), *scalars.one_hot(F.col("code"), list(range(codes)), "code"))])


def static_vector(stations: list, horizons: tuple[int, ...], start: str) -> Column:
    """The channels of `static_names` of a sample as an array of floats."""
    stamps = [c for at in ("origin", "target") for c in scalars.calendar(scalars.hour_timestamp(f"{at}_idx", start))[: len(CYCLES)]]
    return F.array(*[c.cast("float") for c in (*scalars.one_hot(F.col("station"), stations, "s"), *scalars.one_hot(F.col("horizon"), list(horizons), "h"), *stamps)])


def tensors(wide: DataFrame, samples: DataFrame, vector: Column, static: Column, hours: int = 48) -> DataFrame:
    """`samples` with `dynamic`, the vectors of the context that ends at the origin as one flat array, oldest hour first,
    its `shape` (hours, channels), and `static`.

    All contexts of a series come from one window pass; samples meet them by an equi-join. Samples without a whole
    context go.
    """
    last = Window.partitionBy("station").orderBy("hour_idx").rowsBetween(-(hours - 1), 0)
    made = wide.select(F.col("station").alias("_s"), F.col("hour_idx").alias("_h"), F.count(F.lit(1)).over(last).alias("_n"), F.collect_list(vector).over(last).alias("_steps")).filter(F.col("_n") == hours)
    flat = made.select("_s", "_h", F.flatten("_steps").alias("dynamic"), F.array(F.lit(hours), F.size(F.get("_steps", F.lit(0)))).alias("shape"))
    return samples.withColumn("static", static).join(flat, (F.col("station") == F.col("_s")) & (F.col("origin_idx") == F.col("_h"))).drop("_s", "_h")


def checksum(values: Column) -> Column:
    """The sum of an array's values in whole steps, each times its place from 1: it tells two tensors apart without their text."""
    placed = F.transform(values, lambda x, i: steps_of(x) * (i + 1))
    return F.aggregate(placed, F.lit(0).cast("long"), lambda acc, x: acc + x)
