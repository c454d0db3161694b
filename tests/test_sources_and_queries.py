"""Readers, streams, and every query against its SQL."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from gridloom.plans.all import QUERIES, SQL
from gridloom.sources import tables
from gridloom.streaming import panel as streaming

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    return f"{value:.5f}".replace("-0.00000", "0.00000") if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    cur = oracle.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == names
    want = sorted([plain(r[columns.index(c)]) for c in names] for r in cur.fetchall())
    got = sorted([plain(r[c]) for c in names] for r in df.collect())
    assert len(got) == len(want)
    assert all(x == y or abs(float(x) - float(y)) < 2e-5 for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True) if x != y)


def test_station_files(spark, tmp_path):
    (tmp_path / "S1.csv").write_text("No,year,month,day,hour,PM,station\n1,2024,1,1,0,5.5,S1\n2,2024,1,1,1,NA,S1\n3,2024,1,1,2,7,S1\nbroken,row\n")
    raw = tables.station_files(spark, str(tmp_path), ["No", "year", "month", "day", "hour", "PM", "station"]).cache()
    assert raw.filter("_malformed is not null").count() == 1 and raw.first().station_file == "S1"
    time = tables.Timeline("2024-01-01 00:00:00", 24, 1, 1)
    got = {r.hour_idx: r for r in tables.station_observations(raw.filter("_malformed is null"), time, ["PM"], "PM").collect()}
    assert got[0].value == 5.5 and got[1].value is None and got[2].value is None and got[2].present
    manifest = tables.file_manifest(spark, str(tmp_path), "*.csv")
    assert manifest.first().name == "S1.csv" and tables.manifest_digest(manifest).first().files == 1
    tables.write_table(manifest, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exists"):
        tables.write_table(manifest, str(tmp_path / "out"))


def test_malformed_rows_are_flagged_whatever_is_selected(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,c\n1,2,3\n2,3\n4,5,6,7\n")
    rows = tables.station_files(spark, str(tmp_path), ["a", "b", "c"])
    assert {(r.a, r._malformed) for r in rows.select("a", "_malformed").collect()} == {("1", None), ("2", "2,3"), ("4", "4,5,6,7")}


def test_carry_drops_late_hours(spark, tmp_path):
    for i, rows in enumerate(([(0, 0, 1.0), (0, 2, 3.0)], [(0, 1, 9.0), (0, 11, 4.0)])):
        spark.createDataFrame(rows, "station int, hour_idx int, value double").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema("station int, hour_idx int, value double").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        streaming.run_available(streaming.carry(stream, 6, -99.0), str(tmp_path / f"out{i}"), str(tmp_path / "state"), "append")
    rows = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out1")).orderBy("hour_idx").collect()
    assert [(r.hour_idx, r.filled, r.source) for r in rows] == [(h, 3.0, 1) for h in range(3, 9)] + [(9, -99.0, 2), (10, -99.0, 2), (11, 4.0, 0)]


def test_hourly_stream_of_unordered_files(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.station, r.variable, r.hour_idx): (r.n, r.total) for r in QUERIES["stream_hourly"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {r[:3]: r[3:] for r in con.execute(SQL["stream_hourly"]).fetchall()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=2e-4) for k in want)


@pytest.mark.parametrize("name", ["category_counts", "category_counts_all"])
def test_category_counts_take_every_order(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert sum(r.rows for r in rows) == spark.read.parquet(f"{SF}/orders.parquet").count() and sum(r.pct for r in rows) == pytest.approx(100, abs=1e-4)


def test_trees_and_matrix_take_every_eligible_sample(spark):
    from gridloom.operators import samples
    from gridloom.plans import base

    chosen = samples.eligible(base.candidates(spark, SF))
    want = {(r.horizon, r.partition): r["count"] for r in chosen.groupBy("horizon", "partition").count().collect()}
    assert {(r.horizon, r.partition): r.n for r in QUERIES["gbt_fit"](spark, SF).collect()} == want and {h for h, _ in want} == {1, 6, 12, 24}
    made = QUERIES["feature_matrix_b3"](spark, SF).cache()
    assert {r.regime: r["count"] for r in made.groupBy("regime").count().collect()} == dict.fromkeys(("R0", "R1", "R2", "R3"), sum(want.values()))
    row = made.filter("regime = 'R3' and station = 1 and horizon = 6").orderBy("target_idx").first()
    grid = {r.hour_idx: r for r in base.filled_panel(spark, SF).filter("station = 1 and variable = 'view'").collect()}
    assert row.view_lag3 == pytest.approx(grid[row.origin_idx - 3].filled, abs=1e-6) and row.view_observed_lag0 == grid[row.origin_idx].observed
    assert row.view_observed_share6 == pytest.approx(sum(grid[row.origin_idx - k].observed for k in range(6)) / 6, abs=1e-6)
    assert (row.station_0, row.station_1) == (0, 1) and sum(row[f"code_{k}"] for k in range(17)) == 1 and row.target_hour_sin != row.origin_hour_sin
    assert not [c for c in made.columns if row[c] is None]


ALONE = """
import __spark_entry__ as entry
assert len(entry.queries()) > 100 and len(entry.oracle_sql()) > 100
assert not [q for q in entry.queries() if q == 'pipeline' or q.startswith('op') and q[2].isdigit()]
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_llm_subpackage(tmp_path, pipeline):
    """A copy without both llm folders, with and without the pipeline's file, imports and keeps its other queries."""
    repo = Path(__file__).parents[1]
    shutil.copytree(repo / "gridloom", tmp_path / "gridloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * (pipeline and (repo / "corpus_pipeline.py").exists())]:
        shutil.copy(repo / name, tmp_path)
    subprocess.run([sys.executable, "-c", ALONE], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
