"""The event table seen as an hourly panel: shared frames, and the same as DuckDB SQL.

Stations are users modulo 4, variables are event types, the target is `purchase`; 720 hours from 2024-01-01 are split
2:1:1 into train, validation and test. Floats leave the engine rounded to 6 decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalars import hour_index, hour_timestamp, six
from gridloom.operators import baselines, panel, samples
from gridloom.sources.tables import Timeline, event_observations, table, timeline_of
from gridloom.sources.work import written

TIME = Timeline("2024-01-01 00:00:00", 720, 359, 539)
TARGET, STATIONS, SEVERE, LOW = "purchase", 4, 80.0, 30.0
MODELS = ("b0", "b1", "b2")
VARIABLES = ["click", "error", "purchase", "signup", "view"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with DuckDB SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals, other columns as they are."""
    return df.select(*[six(F.col(f"`{c}`")).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def observations(spark: SparkSession, sf: str) -> DataFrame:
    return event_observations(table(spark, sf, "events"), TIME, STATIONS)


def full_panel(spark: SparkSession, sf: str) -> DataFrame:
    return panel.grid(observations(spark, sf), TIME.hours)


def filled_panel(spark: SparkSession, sf: str) -> DataFrame:
    grid = full_panel(spark, sf)
    return panel.causal_fill(grid, panel.train_medians(grid, TIME.train_end))


def target_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The target's series only; the filter reaches the scan."""
    return panel.grid(observations(spark, sf).filter(F.col("variable") == TARGET), TIME.hours)


def filled_target(spark: SparkSession, sf: str) -> DataFrame:
    grid = target_panel(spark, sf)
    return panel.causal_fill(grid, panel.train_medians(grid, TIME.train_end))


def users_seen(spark: SparkSession, sf: str) -> tuple[Timeline, DataFrame]:
    """The table's own timeline, and the target's observed hours of every user, stored once; events without a user are in no series."""
    events = table(spark, sf, "events")
    time = timeline_of(events)
    rows = events.filter((F.col("event_type") == TARGET) & F.col("user_id").isNotNull()).select(F.col("user_id").alias("station"), hour_index("ts", time.start).alias("hour_idx"), "value")
    return time, written(rows.filter(F.col("hour_idx").between(0, time.hours - 1)).groupBy("station", "hour_idx").agg(F.avg("value").alias("value")), "users-seen")


def users_series(time: Timeline, seen: DataFrame, tasks: int | None = None) -> DataFrame:
    """The filled series of every user at every hour."""
    return panel.filled_series(seen, time.hours, time.train_end, tasks or panel.tasks_of(seen, time.hours, ("station",)), keys=("station",))


def user_clock(time: Timeline) -> list[Column]:
    """month and hour of an hour of the table's own timeline."""
    return [f(hour_timestamp("hour_idx", time.start)).alias(n) for n, f in (("month", F.month), ("hour", F.hour))]


def users_target(spark: SparkSession, sf: str) -> tuple[Timeline, DataFrame]:
    """The table's own timeline, and the target's filled series of every user: this panel grows with the table."""
    time, seen = users_seen(spark, sf)
    return time, users_series(time, seen)


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return samples.candidates(target_panel(spark, sf), TIME)


def clock(index: str) -> list[Column]:
    """month and hour of an hour index."""
    stamp = F.expr(f"timestampadd(HOUR, {index}, timestamp_ntz'{TIME.start}')")
    return [F.month(stamp).alias("month"), F.hour(stamp).alias("hour")]


def climatology_table(filled: DataFrame) -> DataFrame:
    return baselines.climatology(filled.filter((F.col("hour_idx") <= TIME.train_end) & F.col("value").isNotNull()).select("station", *clock("hour_idx"), "value"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Eligible samples of all partitions with actual, b0, b1, b2 and how each came about."""
    filled = written(filled_target(spark, sf), "filled")  # read by each join below
    rows = samples.eligible(samples.candidates(filled, TIME)).select("station", "horizon", "target_idx", "origin_idx", "partition", "sample_id", *clock("target_idx"))
    actual = filled.select(F.col("station").alias("_s"), F.col("hour_idx").alias("_h"), F.col("value").alias("actual"))
    rows = rows.join(actual, (F.col("station") == F.col("_s")) & (F.col("target_idx") == F.col("_h"))).drop("_s", "_h")
    rows = baselines.seasonal(baselines.persistence(rows, filled), filled)
    return baselines.climatological(rows, climatology_table(filled))


def tested(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).filter(F.col("partition") == "test")


def errors(spark: SparkSession, sf: str, partition: str | None = "test") -> DataFrame:
    rows = predictions(spark, sf)
    rows = rows.filter(F.col("partition") == partition) if partition else rows
    return baselines.as_long(rows.select("partition", "station", "horizon", "target_idx", "origin_idx", "month", "hour", "actual", *MODELS))


#: DuckDB: observations, grid, fills, samples, predictions, errors. Each text adds to the one before it.
OBS = f"""obs AS (
  SELECT CAST(user_id % {STATIONS} AS INTEGER) AS station, event_type AS variable,
         CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS INTEGER) AS hour_idx, avg(value) AS value
  FROM events WHERE date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) BETWEEN 0 AND 719
  GROUP BY ALL
)"""
GRID = OBS + """, grid AS (
  SELECT s.station, s.variable, CAST(h.i AS INTEGER) AS hour_idx, o.value, o.value IS NOT NULL AS observed
  FROM (SELECT DISTINCT station, variable FROM obs) s CROSS JOIN range(720) h(i)
  LEFT JOIN obs o ON o.station = s.station AND o.variable = s.variable AND o.hour_idx = h.i
)"""
MEDIANS = GRID + """, medians AS (
  SELECT station, variable, coalesce(quantile_cont(value, 0.5) FILTER (WHERE hour_idx <= 359), 0.0) AS train_median
  FROM grid GROUP BY ALL
)"""
FILLED = MEDIANS + """, held AS (
  SELECT g.*, train_median, last_value(value IGNORE NULLS) OVER (PARTITION BY g.station, g.variable ORDER BY hour_idx
         RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS held_value,
         coalesce(least(hour_idx - max(CASE WHEN value IS NOT NULL THEN hour_idx END) OVER (PARTITION BY g.station, g.variable
         ORDER BY hour_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 168), 168) AS gap_age
  FROM grid g JOIN medians m ON g.station = m.station AND g.variable = m.variable
), filled AS (
  SELECT station, variable, hour_idx, value, observed, gap_age, coalesce(held_value, train_median) AS filled,
         CASE WHEN value IS NOT NULL THEN 0 WHEN held_value IS NOT NULL THEN 1 ELSE 2 END AS source
  FROM held
)"""
SAMPLES = FILLED + f""", target AS (SELECT * FROM filled WHERE variable = '{TARGET}')
, candidates AS (
  SELECT station, horizon, hour_idx AS target_idx, hour_idx - horizon AS origin_idx, hour_idx - horizon - 47 AS context_start,
         CASE WHEN hour_idx - horizon - 47 < 0 THEN 'insufficient_history' WHEN NOT observed THEN 'target_missing' ELSE 'eligible' END AS reason,
         CASE WHEN hour_idx <= 359 THEN 'train' WHEN hour_idx <= 539 THEN 'validation' ELSE 'test' END AS partition
  FROM target CROSS JOIN (VALUES (1), (6), (12), (24)) v(horizon)
)"""
PREDICTED = SAMPLES + """, clim AS (
  SELECT station, month(TIMESTAMP '2024-01-01' + to_hours(hour_idx)) AS month, hour(TIMESTAMP '2024-01-01' + to_hours(hour_idx)) AS hour, value
  FROM target WHERE hour_idx <= 359 AND value IS NOT NULL
), c0 AS (SELECT station, month, hour, quantile_cont(value, 0.5) AS m FROM clim GROUP BY ALL)
, c1 AS (SELECT station, hour, quantile_cont(value, 0.5) AS m FROM clim GROUP BY ALL)
, c2 AS (SELECT station, quantile_cont(value, 0.5) AS m FROM clim GROUP BY ALL)
, stamped AS (
  SELECT c.*, month(TIMESTAMP '2024-01-01' + to_hours(target_idx)) AS month, hour(TIMESTAMP '2024-01-01' + to_hours(target_idx)) AS hour
  FROM candidates c WHERE reason = 'eligible'
), predicted AS (
  SELECT s.station, s.horizon, s.target_idx, s.origin_idx, s.partition, s.month, s.hour, a.value AS actual, o.filled AS b0, o.source AS b0_source,
         coalesce(d.value, o.filled) AS b1, d.value IS NOT NULL AS b1_direct, coalesce(c0.m, c1.m, c2.m) AS b2,
         CASE WHEN c0.m IS NOT NULL THEN 0 WHEN c1.m IS NOT NULL THEN 1 WHEN c2.m IS NOT NULL THEN 2 END AS b2_level
  FROM stamped s
  JOIN target a ON a.station = s.station AND a.hour_idx = s.target_idx
  LEFT JOIN target o ON o.station = s.station AND o.hour_idx = s.origin_idx
  LEFT JOIN target d ON d.station = s.station AND d.hour_idx = s.target_idx - 24 AND s.target_idx - 24 <= s.origin_idx AND d.value IS NOT NULL
  LEFT JOIN c0 ON c0.station = s.station AND c0.month = s.month AND c0.hour = s.hour
  LEFT JOIN c1 ON c1.station = s.station AND c1.hour = s.hour
  LEFT JOIN c2 ON c2.station = s.station
)"""
ALL_ERRORS = PREDICTED + """, all_errors AS (
  SELECT partition, station, horizon, target_idx, origin_idx, month, hour, model, prediction, actual, actual - prediction AS residual
  FROM (SELECT *, unnest(['b0', 'b1', 'b2']) AS model, unnest([b0, b1, b2]) AS prediction FROM predicted)
  WHERE prediction IS NOT NULL
)"""
ERRORS = ALL_ERRORS + ", errors AS (SELECT * FROM all_errors WHERE partition = 'test')"
#: The panel of all users over the table's own hours.
USERS = f"""span AS (
  SELECT date_trunc('hour', min(ts)) AS t0, CAST(date_diff('hour', date_trunc('hour', min(ts)), max(ts)) + 1 AS INTEGER) AS hours FROM events
), parts AS (SELECT t0, hours, hours // 2 - 1 AS train_end, hours * 3 // 4 - 1 AS validation_end FROM span
), uobs AS (
  SELECT user_id AS station, CAST(date_diff('hour', t0, ts) AS INTEGER) AS hour_idx, avg(value) AS value FROM events, parts WHERE event_type = '{TARGET}' GROUP BY ALL
), ugrid AS (
  SELECT s.station, CAST(i AS INTEGER) AS hour_idx, o.value, o.value IS NOT NULL AS observed, CASE WHEN i <= train_end THEN 'train' WHEN i <= validation_end THEN 'validation' ELSE 'test' END AS partition
  FROM (SELECT DISTINCT station FROM uobs) s CROSS JOIN parts CROSS JOIN LATERAL (SELECT unnest(range(hours)) AS i) h LEFT JOIN uobs o ON o.station = s.station AND o.hour_idx = i
), umedian AS (SELECT station, coalesce(quantile_cont(value, 0.5) FILTER (WHERE partition = 'train'), 0.0) AS train_median FROM ugrid GROUP BY ALL
), uheld AS (
  SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY station ORDER BY hour_idx RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS held FROM ugrid
), ufilled AS (
  SELECT station, hour_idx, value, observed, partition, coalesce(held, train_median) AS filled, CASE WHEN value IS NOT NULL THEN 0 WHEN held IS NOT NULL THEN 1 ELSE 2 END AS source FROM uheld JOIN umedian USING (station)
), usamples AS (
  SELECT partition || '|' || station || '|' || strftime(t0 + to_hours(hour_idx), '%Y%m%d%H') || '|h' || horizon AS sample_id, station, CAST(horizon AS INTEGER) AS horizon, hour_idx AS target_idx,
         CAST(hour_idx - horizon AS INTEGER) AS origin_idx, partition
  FROM ufilled CROSS JOIN parts CROSS JOIN (VALUES (1), (6), (12), (24)) v(horizon) WHERE observed AND hour_idx - horizon - 47 >= 0
)"""
#: Select lists over errors.
MAE, RMSE = "avg(abs(residual))", "sqrt(avg(residual * residual))"
R2 = "1 - sum(residual * residual) / nullif(var_pop(actual) * count(actual), 0)"
UNDER = "100.0 * count(*) FILTER (WHERE residual > 0) / count(*)"
SUMMARY = f"count(*) AS n, round({MAE}, 6) AS mae, round({RMSE}, 6) AS rmse, round(avg(residual), 6) AS mean_residual, round(CAST({UNDER} AS DOUBLE), 6) AS underprediction_pct, round({R2}, 6) AS r2"


def corr_sql(x: str, y: str, least: int = 3) -> str:
    """Guarded correlation of columns without nulls."""
    return f"CASE WHEN count(*) >= {least} THEN covar_pop({x}, {y}) / nullif(sqrt(var_pop({x})) * sqrt(var_pop({y})), 0) END"
