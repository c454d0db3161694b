"""Zip archives as tables: every member of every archive, archives within archives too, with sizes and digests.

Archives come as rows (path, content), as Spark's `binaryFile` source reads them. A row is opened where it lies; members
are read in blocks, so no member is held whole, except for an archive within an archive, which must be. A task has one
archive of a batch in Python at a time, and hands on `ROWS` rows. Defined cases:
null or broken content gives one row with status `corrupt`; a member whose name is absolute or climbs out of its folder
has status `unsafe` and isn't read; folders are left out; equal names within an archive give a row each.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, ROWS = 1 << 20, 256
MEMBERS = "archive string, member string, bytes long, sha256 string, status string"
MEMBER_TYPES = pa.schema([("archive", pa.string()), ("member", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("status", pa.string())])
PACKED_TYPES = pa.schema([("path", pa.string()), ("content", pa.binary())])


def archive_files(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """path, content of the archives in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def unsafe(name: str) -> bool:
    """Absolute, with a drive, or with a step to a parent folder, by either kind of slash."""
    parts = name.replace("\\", "/").split("/")
    return posixpath.isabs(name.replace("\\", "/")) or ".." in parts or parts[0].endswith(":")


def members(content: bytes | None, depth: int, within: str = "") -> Iterator[tuple[str, int | None, str | None, str]]:
    """(member, bytes, sha256, status) of an archive; members of inner archives are named outer!inner."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content or b""))
    except zipfile.BadZipFile:
        yield within, None, None, "corrupt"
        return
    for info in archive.infolist():
        if info.is_dir():
            continue
        name = f"{within}!{info.filename}" if within else info.filename
        if unsafe(info.filename):
            yield name, None, None, "unsafe"
            continue
        inner = depth > 0 and info.filename.lower().endswith(".zip")
        size, digest, held = 0, hashlib.sha256(), []
        try:
            with archive.open(info) as member:
                while block := member.read(BLOCK):
                    size += len(block)
                    digest.update(block)
                    if inner:
                        held.append(block)
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):  # a wrong sum, a cut, an unknown method, a password
            yield name, None, None, "corrupt"
            continue
        yield name, size, digest.hexdigest(), "archive" if inner else "file"
        if inner:
            yield from members(b"".join(held), depth - 1, name)


def scalars(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, each made when it is asked for."""
    for row in zip(*batch.columns, strict=True):
        yield tuple(x.as_py() for x in row)


def in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of `ROWS`."""
    while held := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def archive_members(files: DataFrame, depth: int = 1) -> DataFrame:
    """archive, member, bytes, sha256, status of rows (path, content); `depth` levels of inner archives are opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from in_batches(((path, *row) for path, content in scalars(batch) for row in members(content, depth)), MEMBER_TYPES)

    return files.select("path", "content").mapInArrow(run, MEMBERS)


def checked_members(found: DataFrame) -> DataFrame:
    """The members as they are; the query fails where one is unsafe or corrupt."""
    return found.filter(F.assert_true(F.col("status").isin("file", "archive"), F.concat(F.lit("refused member: "), "archive", F.lit("!"), "member")).isNull())


def member_manifest(found: DataFrame) -> DataFrame:
    """archive, members, bytes, sha256: one digest of each archive, over the lines `member:sha256` of its files in order."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("member", "sha256"))), lambda s: F.concat_ws(":", s["member"], s["sha256"])), "\n")
    files = found.filter(F.col("status") == "file")
    return files.groupBy("archive").agg(F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("bytes"), F.sha2(F.concat(lines, F.lit("\n")), 256).alias("sha256"))


def packed(rows: DataFrame, archive: str, member: str, content: str, inner: str = "data.zip") -> DataFrame:
    """path, content: an archive for each value of a column, with one inner archive of its members. Made from rows of few
    members an archive, as samples for a scan."""

    def zipped(parts: list[tuple[str, bytes]]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
            for name, data in parts:
                made.writestr(zipfile.ZipInfo(name), data)
        return out.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = ((path, [(m["member"], m["content"].encode()) for m in parts]) for path, parts in scalars(batch))
            yield from in_batches(((path, zipped([("README.txt", b"orders by status\n"), (inner, zipped(parts))])) for path, parts in files), PACKED_TYPES)

    named = rows.select(F.col(archive).cast("string").alias("archive"), F.struct(F.col(member).alias("member"), F.col(content).alias("content")).alias("part"))
    return named.groupBy("archive").agg(F.sort_array(F.collect_list("part")).alias("parts")).mapInArrow(run, "path string, content binary")
