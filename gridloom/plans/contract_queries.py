"""Queries over sample indexes, splits, sealed hours, accessors and completions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import contracts, features, metrics, models, panel, samples
from gridloom.plans.base import ERRORS, FILLED, MAE, PREDICTED, SAMPLES, STATIONS, TARGET, TIME, candidates, errors, filled_panel, filled_target, predictions, query, rounded, target_panel
from gridloom.sources.tables import table

H = "CAST(horizon AS INTEGER) AS horizon"
STAMP = "TIMESTAMP '2024-01-01' + to_hours(target_idx)"
ID = f"partition || '|' || station || '|' || strftime({STAMP}, '%Y%m%d%H') || '|h' || horizon"


def chosen(spark, sf):
    return samples.eligible(candidates(spark, sf))


@query("""WITH f AS (SELECT CAST(user_id % 4 AS INTEGER) AS station, event_type, event_id, value FROM events), shown AS (
  SELECT station, string_agg(event_id, ',' ORDER BY event_id) AS examples FROM (SELECT DISTINCT station, event_id, row_number() OVER (PARTITION BY station ORDER BY event_id) AS k FROM f WHERE value > 190) WHERE k <= 5 GROUP BY ALL
) SELECT t.*, coalesce(examples, '') AS examples FROM (SELECT station, count(*) AS rows, count(*) FILTER (WHERE value > 190) AS bad, count(DISTINCT event_type) AS kinds,
  round(count(*) FILTER (WHERE value > 190) / count(*), 8) AS bad_rate FROM f GROUP BY GROUPING SETS ((), (station))) t LEFT JOIN shown s ON s.station = t.station""")
def file_rollup(spark, sf):
    rows = table(spark, sf, "events").select((F.col("user_id") % STATIONS).cast("int").alias("station"), "event_type", "event_id", "value")
    return contracts.file_rollup(rows, "station", "event_type", F.col("value") > 190, F.col("event_id")).select("station", "rows", "bad", "kinds", "bad_rate", "examples")


@query("""WITH n AS (SELECT user_id % 4 AS s, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM events GROUP BY ALL)
SELECT count(*) AS files, count(DISTINCT names) AS distinct_schemas, count(DISTINCT names) <= 1 AS agree FROM n""")
def schema_agreement(spark, sf):
    return contracts.schema_agreement(table(spark, sf, "events").withColumn("station", F.col("user_id") % STATIONS), "station", "event_type")


@query(f"""WITH {SAMPLES} SELECT count(*) AS rows, count(DISTINCT {ID}) AS ids, count(*) FILTER (WHERE origin_idx <> target_idx - horizon) AS bad_origin, count(*) FILTER (WHERE target_idx NOT BETWEEN 0 AND 719) AS out_of_bounds,
  count(*) FILTER (WHERE context_start < 0 OR origin_idx - context_start + 1 <> 48) AS bad_context, CAST(0 AS BIGINT) AS value_columns FROM candidates WHERE reason = 'eligible'""")
def index_violations(spark, sf):
    return contracts.index_violations(contracts.checked_index(chosen(spark, sf), TIME, samples.CONTEXT), TIME, samples.CONTEXT)


@query(f"""WITH {SAMPLES}, e AS (SELECT {ID} AS sample_id, station, origin_idx FROM candidates WHERE reason = 'eligible')
SELECT sample_id, count(*) AS steps, count(value) AS seen, round(coalesce(sum(value), 0), 4) AS total, round(max(filled) FILTER (WHERE hour_idx = origin_idx - 47), 6) AS oldest, round(max(filled) FILTER (WHERE hour_idx = origin_idx), 6) AS newest
FROM e JOIN target t ON t.station = e.station AND t.hour_idx BETWEEN origin_idx - 47 AND origin_idx GROUP BY ALL""")
def window_by_sample(spark, sf):
    rows = contracts.window_of(chosen(spark, sf), filled_target(spark, sf), ["value", "filled"], samples.CONTEXT)
    total = F.aggregate("steps", F.lit(0.0), lambda acc, s: acc + F.coalesce(s["value"], F.lit(0.0)))
    seen = F.size(F.filter("steps", lambda s: s["value"].isNotNull())).cast("long")
    ends = [F.element_at("steps", i)["filled"].alias(n) for i, n in ((1, "oldest"), (-1, "newest"))]
    return rounded(rows.select("sample_id", F.size("steps").cast("long").alias("steps"), seen.alias("seen"), F.round(total, 4).alias("total"), *ends))


@query(f"""WITH {SAMPLES}, w AS (SELECT station, hour_idx, value, source, count(*) FILTER (WHERE observed) OVER v AS observed_in_window, avg(round(filled * 100)) OVER v AS filled_mean
  FROM target WINDOW v AS (PARTITION BY station ORDER BY hour_idx ROWS BETWEEN 47 PRECEDING AND CURRENT ROW))
SELECT {ID.replace("station", "c.station")} AS sample_id, round(value, 6) AS native_at, source AS source_at, observed_in_window, round(filled_mean, 6) AS filled_mean
FROM candidates c JOIN w ON w.station = c.station AND w.hour_idx = c.origin_idx WHERE reason = 'eligible'""")
def guarded_accessors(spark, sf):
    """The mean is over whole cents, whose sums are exact in any order."""
    cents = filled_target(spark, sf).withColumn("filled", F.round(F.col("filled") * 100))
    rows = contracts.guarded_accessors(chosen(spark, sf), cents, samples.CONTEXT)
    return rounded(rows.select("sample_id", "native_at", "source_at", "observed_in_window", "filled_mean"))


@query(f"""WITH {FILLED} SELECT station, hour_idx, CASE WHEN hour_idx <= 539 THEN round(filled, 6) END AS filled, CASE WHEN hour_idx <= 539 THEN CAST(floor(filled) AS INTEGER) % 16 ELSE -99 END AS code, hour_idx <= 539 AS usable
FROM filled WHERE variable = '{TARGET}'""")
def masked_after_ceiling(spark, sf):
    coded = filled_target(spark, sf).withColumn("code", F.floor("filled").cast("int") % 16)
    return rounded(contracts.masked_after(coded, TIME.validation_end, "filled", "code").select("station", "hour_idx", "filled", "code", "usable"))


@query(f"""WITH {FILLED}, p AS (SELECT CASE WHEN hour_idx <= 359 THEN 'train' WHEN hour_idx <= 539 THEN 'validation' ELSE 'test' END AS partition, hour_idx, observed FROM filled WHERE variable = '{TARGET}')
SELECT partition, count(*) AS hours, max(hour_idx) AS last_hour, max(hour_idx) > 539 AS sealed, CASE WHEN max(hour_idx) <= 539 THEN count(*) FILTER (WHERE observed) END AS observed FROM p GROUP BY ALL""")
def sealed_partitions(spark, sf):
    return contracts.sealed_partitions(target_panel(spark, sf), TIME, TIME.validation_end)


@query(f"""WITH {SAMPLES} SELECT CASE WHEN target_idx <= 287 THEN 'core' ELSE 'tuning' END AS part, {H}, count(*) AS n, min(target_idx) AS first, max(target_idx) AS last
FROM candidates WHERE reason = 'eligible' AND partition = 'train' GROUP BY ALL""")
def core_tuning_split(spark, sf):
    rows = contracts.internal_split(chosen(spark, sf).filter(F.col("partition") == "train"), 287)
    return rows.groupBy("part", "horizon").agg(F.count(F.lit(1)).alias("n"), F.min("target_idx").alias("first"), F.max("target_idx").alias("last"))


@query(f"""WITH {SAMPLES}, e AS (SELECT {ID} AS sample_id, partition, CASE WHEN target_idx <= 287 THEN 'core' ELSE 'tuning' END AS part FROM candidates WHERE reason = 'eligible')
, own AS (SELECT sample_id, count(DISTINCT part) AS parts FROM e GROUP BY ALL), whole AS (SELECT DISTINCT sample_id FROM e WHERE partition = 'train')
SELECT max(parts) AS most_parts, count(*) FILTER (WHERE parts > 1) AS twice, count(*) FILTER (WHERE o.sample_id IS NULL) AS missing, count(*) FILTER (WHERE w.sample_id IS NULL) AS "foreign" FROM own o FULL JOIN whole w ON o.sample_id = w.sample_id""")
def split_check(spark, sf):
    """The split of the training samples covers them without overlap; samples of other partitions are foreign to it."""
    rows = chosen(spark, sf)
    return contracts.split_check(contracts.internal_split(rows, 287), rows.filter(F.col("partition") == "train"), "sample_id")


@query(f"WITH {SAMPLES} SELECT {ID} AS sample_id, row_number() OVER (ORDER BY station, horizon, target_idx) - 1 AS position FROM candidates WHERE reason = 'eligible'")
def ordered_samples(spark, sf):
    return contracts.numbered(chosen(spark, sf), ["station", "horizon"], ["target_idx"]).select("sample_id", "position")


@query(f"""WITH {PREDICTED}, g AS (SELECT target_idx, horizon FROM predicted GROUP BY ALL HAVING bool_or(actual >= 80))
SELECT p.station, CAST(p.horizon AS INTEGER) AS horizon, p.target_idx, round(actual, 6) AS actual FROM predicted p SEMI JOIN g ON g.target_idx = p.target_idx AND g.horizon = p.horizon""")
def severe_groups(spark, sf):
    rows = contracts.groups_with(predictions(spark, sf), ["target_idx", "horizon"], F.col("actual") >= 80)
    return rounded(rows.select("station", "horizon", "target_idx", "actual"))


@query(f"""WITH {ERRORS}, c AS (SELECT model, station, horizon, {MAE} AS mae FROM errors GROUP BY ALL)
SELECT model, station, {H}, round(CASE WHEN model = 'b2' THEN mae ELSE floor(mae) END, 6) AS mae, CASE WHEN model = 'b2' THEN 'computed' ELSE 'frozen' END AS origin FROM c""")
def frozen_rows(spark, sf):
    """An earlier table, here with whole numbers, stays as it was for all models but the own one."""
    cells = metrics.cells(errors(spark, sf)).select("model", "station", "horizon", "mae")
    return rounded(contracts.enriched(cells, cells.withColumn("mae", F.floor("mae").cast("double")), "b2"))


@query("""WITH a AS (SELECT o_custkey, max(o_totalprice) AS spent FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT o_custkey, min(o_totalprice) AS spent FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN a.spent ELSE b.spent END AS spent FROM customer LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN b ON b.o_custkey = c_custkey""")
def conditional_completion(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    side = lambda status, f: orders.filter(F.col("o_orderstatus") == status).groupBy("c_custkey").agg(f("o_totalprice").alias("spent"))
    return contracts.completed(table(spark, sf, "customer"), side("F", F.max), side("O", F.min), "c_custkey", "spent", F.col("c_nationkey") < 10).select("c_custkey", "spent")


@query(f"""WITH {SAMPLES}, e AS (SELECT {ID} AS sample_id, TIMESTAMP '2024-01-01' + to_hours(origin_idx) AS o, {STAMP} AS t FROM candidates WHERE reason = 'eligible')
SELECT sample_id, """ + ", ".join(f"round({f}(hour({a}) * (2 * pi()) / 24), 6) + 0.0 AS {n}_hour_{f}" for a, n in (("o", "origin"), ("t", "target")) for f in ("sin", "cos")) + " FROM e")
def calendar_both_ends(spark, sf):
    made = [c.alias(f"{at}_{n}") for at in ("origin", "target") for n, c in zip(features.CYCLES[:2], scalars.calendar(scalars.hour_timestamp(f"{at}_idx", TIME.start)), strict=False)]
    rows = rounded(chosen(spark, sf).select("sample_id", *made))
    return rows.select("sample_id", *[(F.col(c) + 0.0).alias(c) for c in rows.columns[1:]])  # no negative zeros


@query(f"""WITH {ERRORS}, f AS (SELECT DISTINCT model, CAST(horizon AS INTEGER) AS horizon FROM errors), e AS (SELECT model, horizon FROM (VALUES ('b0'), ('b1'), ('b3')) m(model) CROSS JOIN (VALUES (1), (6), (12), (24)) h(horizon))
SELECT (SELECT count(*) FROM (SELECT * FROM f INTERSECT SELECT * FROM e)) AS matched, (SELECT count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM f)) AS missing, (SELECT count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM e)) AS extra""")
def run_set_difference(spark, sf):
    expected = spark.createDataFrame([(m, h) for m in ("b0", "b1", "b3") for h in samples.HORIZONS], "model string, horizon int")
    return contracts.set_difference(errors(spark, sf), expected, ["model", "horizon"])


@query(f"WITH {ERRORS} SELECT model, {H}, count(*) AS n FROM errors GROUP BY ALL")
def confirmed_models(spark, sf):
    rows = contracts.only_confirmed(errors(spark, sf), "model", ["b0", "b1", "b2"])
    return rows.groupBy("model", "horizon").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT p_brand AS name, CAST(sum(l_quantity) AS DOUBLE) AS gain FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY gain DESC, name) AS INTEGER) AS place, name, gain, round(gain / sum(gain) OVER (), 6) AS share FROM g""")
def importance_order(spark, sf):
    """Brands stand for features, quantities for gains."""
    sold = table(spark, sf, "lineitem").select("l_partkey", "l_quantity").join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    gains = sold.groupBy(F.col("p_brand").alias("name")).agg(F.sum("l_quantity").cast("double").alias("gain"))
    return rounded(contracts.importance(gains, "name", "gain"))


@query(f"WITH {FILLED} SELECT station, variable, hour_idx, round(gap_age / 168, 6) AS scaled_age, CAST(coalesce(value > 50, false) AS INTEGER) AS high FROM filled")
def scaled_ages(spark, sf):
    rows = panel.gap_age(filled_panel(spark, sf))
    return rounded(rows.select("station", "variable", "hour_idx", scalars.scaled_gap_age(F.col("gap_age")).alias("scaled_age"), scalars.occurred(F.col("value") - 50).alias("high")))


@query("SELECT CAST(r_regionkey AS INTEGER) AS kernel, CAST(1 + list_sum([2 * (r_regionkey - 1) * d for d in [1, 2, 4, 8]]) AS INTEGER) AS steps FROM region")
def receptive_fields(spark, sf):
    kernels = table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("kernel"))
    dilations = F.array(*map(F.lit, (1, 2, 4, 8)))
    wide = F.aggregate(dilations, F.lit(1), lambda acc, d: acc + F.lit(2) * (F.col("kernel") - 1) * d)
    fixed = [F.when(F.col("kernel") == k, scalars.receptive_field(k, dilations)) for k in range(1, 5)]
    return kernels.select("kernel", F.coalesce(*fixed, wide).cast("int").alias("steps"))


@query(f"WITH {PREDICTED} SELECT station, {H}, round(avg(abs(actual - b2)) FILTER (WHERE b0_source = 0), 6) AS loss FROM predicted GROUP BY ALL")
def masked_loss(spark, sf):
    rows = predictions(spark, sf).withColumn("observed", F.col("b0_source") == 0).withColumn("prediction", F.col("b2"))
    return rounded(models.masked_l1(rows, ["station", "horizon"]))


@query(f"WITH {PREDICTED} SELECT partition, {H}, count(*) AS n, round(avg(b0), 6) AS mean FROM predicted GROUP BY ALL")
def scored_once(spark, sf):
    """Every sample has one finite prediction, or the query fails."""
    rows = predictions(spark, sf)
    made = samples.scored_once(rows.select("sample_id", F.col("b0").alias("prediction")), chosen(spark, sf))
    return rounded(made.groupBy("partition", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean")))
