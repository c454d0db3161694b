"""Readers: hourly panels from event tables and station files, and a manifest of landed files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalars import hour_index


@dataclass(frozen=True)
class Timeline:
    """A closed range of hours and its partitions: train, validation and test by index of the last hour."""

    start: str
    hours: int
    train_end: int
    validation_end: int

    def partition(self, index):
        return F.when(index <= self.train_end, "train").when(index <= self.validation_end, "validation").otherwise("test")


def timeline_of(events: DataFrame, ts: str = "ts") -> Timeline:
    """The hours that a table of events spans, in halves: train, then validation and test of a quarter each."""
    row = events.agg(F.date_format(F.date_trunc("hour", F.min(ts)), "yyyy-MM-dd HH:mm:ss").alias("start"), F.expr(f"cast(timestampdiff(HOUR, date_trunc('hour', min({ts})), max({ts})) as int)").alias("last")).first()
    hours = 0 if row.start is None else row["last"] + 1
    return Timeline(row.start or "1970-01-01 00:00:00", hours, hours // 2 - 1, hours * 3 // 4 - 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_observations(events: DataFrame, timeline: Timeline, stations: int = 4) -> DataFrame:
    """station, variable, hour_idx, value: the mean of a variable's events in each hour."""
    rows = events.select((F.col("user_id") % stations).cast("int").alias("station"), F.col("event_type").alias("variable"), hour_index("ts", timeline.start).alias("hour_idx"), "value")
    return rows.filter(F.col("hour_idx").between(0, timeline.hours - 1)).groupBy("station", "variable", "hour_idx").agg(F.avg("value").alias("value"))


def station_files(spark: SparkSession, path: str, header: list[str], corrupt: str = "_malformed") -> DataFrame:
    """Raw station files as text columns with `station_file`; rows with another number of fields land in `corrupt`.

    Every field is parsed, whatever a plan selects: with pruned columns, rows with too few fields would pass for whole.
    """
    schema = ", ".join(f"`{c}` string" for c in [*header, corrupt])
    rows = spark.read.option("columnPruning", False).csv(path, schema=schema, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt, enforceSchema=True)
    return rows.withColumn("station_file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))


def station_observations(raw: DataFrame, timeline: Timeline, variables: list[str], target: str) -> DataFrame:
    """station, variable, hour_idx, value, present: targets after the train end keep their presence, not their value."""
    stamp = F.expr("make_timestamp_ntz(try_cast(year as int), try_cast(month as int), try_cast(day as int), try_cast(hour as int), 0, 0)")
    long = raw.withColumn("ts", stamp).unpivot(["station", "ts"], variables, "variable", "raw")
    value = F.when(~F.col("raw").isin("NA", ""), F.col("raw").try_cast("double"))
    long = long.select("station", "variable", hour_index("ts", timeline.start).alias("hour_idx"), value.alias("value")).withColumn("present", F.col("value").isNotNull())
    sealed = (F.col("variable") == target) & (F.col("hour_idx") > timeline.train_end)
    return long.withColumn("value", F.when(~sealed, F.col("value")))


def file_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """name, bytes, sha256 of every landed file under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_digest(manifest: DataFrame) -> DataFrame:
    """One digest over `name:sha256` lines in order of names; a manifest has one short row per file."""
    lines = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "name", "sha256"))), "\n")
    return manifest.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.concat(lines, F.lit("\n")), 256).alias("sha256"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Write-once sink: an existing target is an error."""
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("lineSep", "\n")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
