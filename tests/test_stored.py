"""Stored layers: pruning, refusals, buckets, digests, locks, archives."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from gridloom.functions.digests import table_digest
from gridloom.operators import panel
from gridloom.plans import base, stored_queries
from gridloom.sources import archives, stored
from gridloom.sources.tables import Timeline, table, timeline_of
from gridloom.sources.work import shared_folder

TIME = Timeline("2024-01-01 00:00:00", 40, 19, 29)


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def path(spark):
    rows = spark.range(80).select((F.col("id") % 2).alias("station"), F.floor(F.col("id") / 2).cast("int").alias("hour_idx"), F.when(F.col("id") % 7 != 0, F.col("id").cast("double")).alias("value"))
    rows = rows.withColumn("observed", F.col("value").isNotNull()).withColumn("filled", F.coalesce("value", F.lit(0.0))).withColumn("source", F.lit(0))
    out = shared_folder(spark, "test-panel")
    stored.store_panel(rows, out, TIME)
    return out


def test_one_partition_is_read_and_values_are_refused_in_the_plan(spark, path):
    train = stored.open_partition(spark, path, "train")
    assert re.search(r"PartitionFilters: \[isnotnull\(partition#\d+\), \(partition#\d+ = train\)\]", plan(train)) and train.count() == 40
    assert all("partition=train" in f for f in train.select("value").inputFiles()) or "partition=train" in str(train.inputFiles())
    shown = stored.open_partition(spark, path, "test", "presence")
    assert shown.columns == ["station", "hour_idx", "observed", "partition"] and shown.count() == 20
    assert "value" not in re.search(r"ReadSchema: (.*)", plan(shown)).group(1)
    for partition, mode in (("test", "values"), ("validation", "values"), ("train", "both"), ("later", "presence")):
        with pytest.raises(stored.Refused):
            stored.open_partition(spark, path, partition, mode)
    with pytest.raises(Exception, match="already exists"):
        stored.store_panel(train, path, TIME)


def test_actuals_of_other_partitions_are_refused(spark, path):
    asked = lambda rows: stored.actuals(spark, path, "validation", spark.createDataFrame(rows, "station long, target_idx int, prediction double"))
    got = asked([(0, 20, 1.0), (1, 29, 2.0)])
    assert "partition#" in plan(got) and sorted((r.target_idx, r.actual) for r in got.collect()) == [(20, 40.0), (29, 59.0)]
    for bad, says in (((0, 19, 1.0), "outside"), ((0, 30, 1.0), "outside"), ((9, 25, 1.0), "outside"), ((0, 25, None), "without a prediction")):
        with pytest.raises(Exception, match=says):
            asked([(0, 20, 1.0), bad]).collect()


def test_windows_over_buckets_need_no_exchange(spark):
    sf = "/root/testdata/sf0.001"
    series, index = stored_queries.stored_layers(spark, sf, 4)
    rows = stored_queries.windowed(stored.stored(spark, series, ["station", "hour_idx", "observed", "filled"]))
    text = plan(rows)
    assert "Window" in text and "Exchange" not in text and "Bucketed: true" in text
    assert re.search(r"ReadSchema: (.*)", text).group(1) == "struct<station:bigint,hour_idx:int,observed:boolean,filled:double>"
    by_file = [r[0] for r in spark.table(series).groupBy(F.input_file_name()).agg(F.countDistinct("station")).select("count(DISTINCT station)").collect()]
    assert len(by_file) <= 4
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:  # then the join on station and hour needs none either
        held = rows.withColumnsRenamed({"station": "_s", "hour_idx": "_h"})
        joined = stored.stored(spark, index, ["sample_id", "station", "origin_idx"]).hint("merge").join(held, (F.col("station") == F.col("_s")) & (F.col("origin_idx") == F.col("_h")))
        assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")


def test_statistics_read_back_scale_alike_and_changes_are_found(spark):
    grid = base.full_panel(spark, "/root/testdata/sf0.001").withColumn("filled", F.coalesce("value", F.lit(0.0)))
    statistics = panel.scaling_statistics(grid, base.TIME.train_end)
    out = shared_folder(spark, "test-statistics")
    stored.sealed(statistics, out, version="7")
    assert stored.lock_of(spark, out)["version"] == "7"
    ways = [sorted((r.station, r.variable, r.hour_idx, r.scaled) for r in panel.scaled(grid, s).collect()) for s in (statistics, stored.unsealed(spark, out))]
    assert ways[0] == ways[1]
    with pytest.raises(Exception, match="already exists"):
        stored.sealed(statistics, out)
    changed = spark.read.parquet(f"{out}/rows").withColumn("median", F.when(F.col("variable") == "view", F.col("median") + 0.01).otherwise(F.col("median"))).collect()
    spark.createDataFrame(changed, statistics.schema).write.mode("overwrite").parquet(f"{out}/rows")
    with pytest.raises(stored.Refused, match="not the one that was locked"):
        stored.unsealed(spark, out)


def test_scores_need_the_predictions_that_were_locked(spark, path):
    out = shared_folder(spark, "test-locks")
    predictions = spark.createDataFrame([(0, h, float(h)) for h in range(30, 40)], "station long, target_idx int, prediction double")
    stored.sealed(predictions, f"{out}/p")
    scores = stored.score_locked(spark, f"{out}/p", path, "test", ["station"])
    seen = [h for h in range(30, 40) if 2 * h % 7]
    assert [(r.n, r.mae) for r in scores.collect()] == [(len(seen), pytest.approx(sum(seen) / len(seen)))]
    stored.lock_results(scores, f"{out}/r", f"{out}/p")
    assert stored.locked_results(spark, f"{out}/r", f"{out}/p").count() == 1
    stored.sealed(predictions.withColumn("prediction", F.col("prediction") + 1), f"{out}/other")
    with pytest.raises(stored.Refused, match="other predictions"):
        stored.locked_results(spark, f"{out}/r", f"{out}/other")
    predictions.withColumn("prediction", F.when(F.col("target_idx") == 33, 0.0).otherwise(F.col("prediction"))).write.mode("overwrite").parquet(f"{out}/p/rows")
    for late in (lambda: stored.score_locked(spark, f"{out}/p", path, "test", ["station"]), lambda: stored.locked_results(spark, f"{out}/r", f"{out}/p")):
        with pytest.raises(stored.Refused, match="not the one that was locked"):
            late()


def test_digests_hold_in_any_order(spark):
    rows = [(1, 0.1 + 0.2, None, True), (2, -0.0, "a|b", False), (2, -0.0, "a|b", False), (None, float("1e6"), "", None)]
    df = spark.createDataFrame(rows, "i long, x double, s string, b boolean")
    digests = {tuple(table_digest(d, ["i", "x", "s", "b"]).first()) for d in (df, df.repartition(3), df.orderBy(F.desc("i")), spark.createDataFrame([(1, 0.3, None, True), *rows[1:]], df.schema))}
    assert len(digests) == 1
    assert table_digest(df.limit(3), ["i", "x", "s", "b"]).first().digest not in {d for _, d in digests}
    assert table_digest(df.limit(0), ["i"]).first()["rows"] == 0


def test_the_timeline_is_that_of_the_table(spark):
    found = timeline_of(table(spark, "/root/testdata/sf0.001", "events"))
    row = table(spark, "/root/testdata/sf0.001", "events").agg(F.min("ts"), F.max("ts")).first()
    assert found.start == row[0].strftime("%Y-%m-%d %H:00:00") and found.hours == int((row[1] - row[0].replace(minute=0, second=0, microsecond=0)).total_seconds() // 3600) + 1
    assert timeline_of(table(spark, "/root/testdata/sf0.001", "events").limit(0)).hours == 0


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as made:
        for name, content in files:
            made.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


def test_archives(spark, tmp_path):
    inner = zipped([("d/a.csv", b"1,2\n"), ("../b.csv", b"x"), ("d/", b""), ("deep.zip", zipped([("c", b"c")]))])
    files = {"good.zip": zipped([("in.ZIP", inner), ("note", b"n" * 3_000_000)]), "bad.zip": b"no archive", "cut.zip": inner[:40], "evil.zip": zipped([("/etc/x", b""), ("C:\\y", b""), ("ok", b"")])}
    wrong = bytearray(zipped([("w", b"hello world")]))
    wrong[wrong.index(b"hello")] ^= 1
    files["sum.zip"] = bytes(wrong)
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    rows = archives.archive_members(archives.archive_files(spark, str(tmp_path))).cache()
    got = {(r.archive.rpartition("/")[2], r.member): (r.bytes, r.status) for r in rows.collect()}
    assert got == {
        ("good.zip", "in.ZIP"): (len(inner), "archive"), ("good.zip", "in.ZIP!d/a.csv"): (4, "file"), ("good.zip", "in.ZIP!../b.csv"): (None, "unsafe"), ("good.zip", "note"): (3_000_000, "file"),
        ("good.zip", "in.ZIP!deep.zip"): (len(zipped([("c", b"c")])), "file"), ("bad.zip", ""): (None, "corrupt"), ("cut.zip", ""): (None, "corrupt"),
        ("evil.zip", "/etc/x"): (None, "unsafe"), ("evil.zip", "C:\\y"): (None, "unsafe"), ("evil.zip", "ok"): (0, "file"), ("sum.zip", "w"): (None, "corrupt"),
    }
    with pytest.raises(Exception, match="refused member"):
        archives.checked_members(rows).collect()
    assert archives.checked_members(rows.filter("archive like '%good.zip' and status <> 'unsafe'")).count() == 4
    nothing = spark.createDataFrame([(None, None), ("x", None)], "path string, content binary")
    assert [r.status for r in archives.archive_members(nothing).collect()] == ["corrupt"] * 2


def test_archives_pass_in_short_batches():
    import pyarrow as pa

    taken = []
    rows = ((taken.append(i) or str(i), None) for i in range(archives.ROWS * 2 + 1))
    made = archives.in_batches(rows, archives.PACKED_TYPES)
    first = next(made)
    assert (first.num_rows, len(taken)) == (archives.ROWS, archives.ROWS) and [b.num_rows for b in made] == [archives.ROWS, 1]
    assert list(archives.scalars(pa.RecordBatch.from_pydict({"path": ["a", None], "content": [b"x", None]}))) == [("a", b"x"), (None, None)]
