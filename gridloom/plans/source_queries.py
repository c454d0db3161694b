"""Sinks and readers: tables that are written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.scalars import hour_timestamp
from gridloom.plans.base import GRID, TARGET, TIME, VARIABLES, full_panel, query, rounded
from gridloom.sources import tables
from gridloom.sources.tables import table
from gridloom.sources.work import shared_folder

HEADER = ["station", "year", "month", "day", "hour", *VARIABLES]


def station_rows(spark, sf):
    """The panel as raw station files have it: text fields, one column a variable, NA for missing."""
    wide = full_panel(spark, sf).groupBy("station", "hour_idx").pivot("variable", VARIABLES).agg(F.first("value"))
    stamp = hour_timestamp("hour_idx", TIME.start)
    parts = [part(stamp).cast("string").alias(n) for n, part in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour))]
    return wide.select(F.col("station").cast("string").alias("station"), *parts, *[F.coalesce(F.col(v).cast("string"), F.lit("NA")).alias(v) for v in VARIABLES])


@query(f"""WITH {GRID}, keys AS (SELECT station, hour_idx, variable FROM (SELECT DISTINCT station, hour_idx FROM grid) s CROSS JOIN (SELECT unnest({VARIABLES}) AS variable) v)
SELECT CAST(k.station AS VARCHAR) AS station, k.variable, k.hour_idx, CASE WHEN k.variable <> '{TARGET}' OR k.hour_idx <= {TIME.train_end} THEN round(g.value, 6) END AS value, g.value IS NOT NULL AS present
FROM keys k LEFT JOIN grid g ON g.station = k.station AND g.hour_idx = k.hour_idx AND g.variable = k.variable""")
def station_files(spark, sf):
    """Station files in and out of CSV: targets after the train end keep their presence, not their value."""
    path = shared_folder(spark, "stations")
    tables.write_table(station_rows(spark, sf), path, fmt="csv")
    return rounded(tables.station_observations(tables.station_files(spark, path, HEADER), TIME, VARIABLES, TARGET))


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE c_acctbal < 0) AS malformed, count(*) FILTER (WHERE c_acctbal >= 0) AS whole FROM customer""")
def malformed_rows(spark, sf):
    """Raw files whose customers in debt lack a field: such rows are flagged, not lost."""
    path = shared_folder(spark, "malformed")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")))
    table(spark, sf, "customer").select(line.alias("custkey,nationkey,acctbal")).write.option("header", True).option("sep", "|").csv(path)
    rows = tables.station_files(spark, path, ["custkey", "nationkey", "acctbal"])
    bad = F.col("_malformed").isNotNull() & F.col("custkey").isNotNull()
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("malformed"), F.count_if(~bad).alias("whole"))


@query("""WITH t AS (SELECT n_regionkey, string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS content FROM nation GROUP BY ALL)
SELECT CAST(octet_length(encode(content)) AS BIGINT) AS bytes, sha256(content) AS sha256 FROM t""")
def file_manifest(spark, sf):
    """Bytes and digest of the file that each region's nations make."""
    path = shared_folder(spark, "manifest")
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]), "\n")
    regions = table(spark, sf, "nation").groupBy("n_regionkey").agg(lines.alias("value"))  # at most all nations of a region
    regions.write.partitionBy("n_regionkey").text(path)
    return tables.file_manifest(spark, f"{path}/*", "*.txt").select("bytes", "sha256")


@query("""SELECT n_nationkey AS nation, n_name AS name, count(c_custkey) AS customers, round(CAST(coalesce(sum(c_acctbal), 0) AS DOUBLE), 2) AS balance
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def json_sink(spark, sf):
    """A summary through the JSON sink and back, with its types."""
    path = shared_folder(spark, "json")
    joined = table(spark, sf, "nation").join(table(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    made = joined.groupBy(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name")).agg(F.count("c_custkey").alias("customers"), F.round(F.coalesce(F.sum("c_acctbal"), F.lit(0)).cast("double"), 2).alias("balance"))
    tables.write_table(made, path, fmt="json")
    return spark.read.schema(made.schema).json(path)
