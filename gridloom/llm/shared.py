"""Helpers that several operators share: cutting lineage, checked broadcasts, ASCII text rules."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts, as a trim set and as a regular expression of the words between it.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a side that may be broadcast, and bytes where rows differ in size; a larger side takes a shuffled join.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or in local runs one set here where it is unset.

    On a cluster there is no folder to fall back on: executors don't see each other's disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: lineage ends there, and lost executors lose nothing.

    The table goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes a table made by `written` that no later plan reads."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/gridloom/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows, else as it is: a shuffled join that AQE can split.

    size: the bytes of a row, for tables with arrays; their sum may be `BROADCAST_BYTES` at most.
    """
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(0) if size is None else size), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= BROADCAST_BYTES else df


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while f"_{name}" in taken:
        name += "_"
    return f"_{name}"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; `lower` does that on pure ASCII and is much faster there."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def text_key(text: Column) -> Column:
    """A 64-bit key of a text; null counts as its own text."""
    return F.xxhash64(text)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_texts(texts: pa.Array) -> pa.Array:
    """Texts as an array of its own, null as empty: Arrow's string kernels misread the offsets of cast slices."""
    own = texts.take(pa.array(np.arange(len(texts)))) if texts.offset else texts
    return pc.fill_null(own.cast(pa.large_string()), "")


#: Rows and bytes of text that are worked on at once in a task.
PACK_ROWS, PACK_BYTES = 1024, 2 << 20


def packs(texts: pa.Array, rows: int = PACK_ROWS, most: int = PACK_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with few rows and bytes; a longer text is a run of its own."""
    start, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and (held + size > most or i - start == rows):
            yield start, i
            start, held = i, 0
        held += size
    if len(texts) > start:
        yield start, len(texts)


def trimmed() -> None:
    """Gives freed memory back to the system: Python workers stay, idle, beside the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """A function over the batches of a partition, after whose end freed memory goes back."""

    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        trimmed()

    return tidied
