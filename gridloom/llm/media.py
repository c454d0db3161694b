"""Media columns: ISO media files are walked box by box and their sample tables decoded; payloads are never decoded.

`read_media` gives codec, duration and the byte ranges of samples and keyframes of every track. `write_media` stores a
payload losslessly as 8-bit samples, in access units of 64 bytes, so that files can be made here. Each row stands
alone: one task holds one file at a time, and nothing is shuffled.

Movie fragments are read as well: samples of `moof` boxes follow those of the movie box. `media_columns` tells of the
first track, `read_media` of all; compact sample sizes (`stz2`) are an error.

Defined cases: null files and files that are no ISO media, cut off or inconsistent give null columns and an `error`;
null texts are empty and make the shortest file; equal texts make equal files; extra columns pass through, and the
operator's own columns replace clashing ones.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed values of the format: boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: What the writer does: bytes of a unit, units between keyframes, units of a chunk, samples a second.
UNIT, KEY_EVERY, CHUNK, RATE = 64, 16, 128, 8000


class Malformed(ValueError):
    """A file whose boxes or tables contradict each other."""


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes) -> bytes:
    """A box with version and flags 0."""
    return box(kind, bytes(4), *parts)


def table(form: str, rows: list[tuple[int, ...]]) -> bytes:
    return struct.pack(">I", len(rows)) + b"".join(struct.pack(form, *row) for row in rows)


def write_media(payload: bytes) -> bytes:
    """A file with one sound track of unsigned 8-bit mono samples; len(payload) is a positive multiple of UNIT."""
    units = len(payload) // UNIT
    chunks, rest = divmod(units, CHUNK)
    runs = [(1, CHUNK, 1)] * bool(chunks) + [(chunks + 1, rest, 1)] * bool(rest)
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))

    def moov(first: int) -> bytes:
        offsets = [first + i * CHUNK * UNIT for i in range(chunks + bool(rest))]
        wide = offsets[-1] >= 1 << 32
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", table(">II", [(units, UNIT)])),
            full(b"stss", table(">I", [(i,) for i in range(1, units + 1, KEY_EVERY)])),
            full(b"stsc", table(">III", runs)),
            full(b"stsz", struct.pack(">II", UNIT, units)),
            full(b"co64" if wide else b"stco", table(">Q" if wide else ">I", [(x,) for x in offsets])),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), box(b"url ", struct.pack(">I", 1)))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, len(payload), 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, len(payload)), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8))
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, len(payload), 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    data = box(b"mdat", payload)
    at = len(head) + len(data) - len(payload)
    first = at + len(moov(0))
    first = at + len(moov(first))  # wide offsets make the table longer
    return head + moov(first) + data


def boxes(data: memoryview, start: int, end: int):
    """(kind, start of the body, end) of each box in a range."""
    while start < end:
        if end - start < 8:
            raise Malformed("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise Malformed("a long box header is cut off")
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise Malformed(f"box {kind!r} leaves its parent")
        yield kind, body, stop
        start = stop


def walk(data: memoryview, start: int, end: int) -> list:
    """The nested boxes of a range: (kind, start, end, children). A list of open ranges, not recursion, holds the depth."""
    tree: list = []
    open_ = [(start, end, tree)]
    while open_:
        a, b, into = open_.pop()
        for kind, body, stop in boxes(data, a, b):
            inner: list = []
            into.append((kind, body, stop, inner))
            if kind in CONTAINERS:
                open_.append((body, stop, inner))
    return tree


def at(tree: list, *path: bytes):
    """The first box at a path."""
    for kind, a, b, inner in tree:
        if kind == path[0]:
            return at(inner, *path[1:]) if len(path) > 1 else (a, b)
    raise Malformed(f"no box {path[0]!r}")


def rows(data: memoryview, span: tuple[int, int], form: str, skip: int = 4) -> list[tuple[int, ...]]:
    """The counted rows of a table box; skip: bytes before the count."""
    a, b = span
    width = struct.calcsize(form)
    if b - a < skip + 4 or b - a < skip + 4 + (n := struct.unpack_from(">I", data, a + skip)[0]) * width:
        raise Malformed("a table is cut off")
    return list(struct.iter_unpack(form, data[a + skip + 4 : a + skip + 4 + n * width]))


def read_track(data: memoryview, trak: list) -> dict:
    """codec, seconds, samples (start, end) in order, keys (start, end) of keyframes."""
    stbl = next((inner for kind, _, _, inner in [x for k, _, _, mdia in trak if k == b"mdia" for k2, _, _, minf in mdia if k2 == b"minf" for x in minf] if kind == b"stbl"), None)
    if stbl is None:
        raise Malformed("a track without sample tables")
    a, b = at(trak, b"mdia", b"mdhd")
    scale, length = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    a, b = at(stbl, b"stsd")
    if b - a < 16:
        raise Malformed("no sample entry")
    codec = bytes(data[a + 12 : a + 16]).decode("latin-1")
    a, b = at(stbl, b"stsz")
    fixed, count = struct.unpack_from(">II", data, a + 4)
    if fixed and fixed * count > len(data):
        raise Malformed("more samples than the file holds")
    sizes = [fixed] * count if fixed else [x for (x,) in rows(data, (a, b), ">I", 8)]
    kinds = {k for k, *_ in stbl}
    offsets = [x for (x,) in (rows(data, at(stbl, b"co64"), ">Q") if b"co64" in kinds else rows(data, at(stbl, b"stco"), ">I"))]
    runs = rows(data, at(stbl, b"stsc"), ">III")
    if any(first < 1 for first, *_ in runs) or any(x[0] >= y[0] for x, y in zip(runs[:-1], runs[1:], strict=True)):
        raise Malformed("runs of chunks that don't rise")
    if sum(n for n, _ in rows(data, at(stbl, b"stts"), ">II")) != len(sizes):
        raise Malformed("times and sizes differ in number")
    samples: list[tuple[int, int]] = []
    for i, (first, per_chunk, _) in enumerate(runs):
        last = runs[i + 1][0] if i + 1 < len(runs) else len(offsets) + 1
        for place in offsets[first - 1 : last - 1]:
            for size in sizes[len(samples) : len(samples) + per_chunk]:
                samples.append((place, place + size))
                place += size
    if len(samples) != len(sizes) or samples and max(e for _, e in samples) > len(data):
        raise Malformed("sample tables don't cover the samples")
    keys = [k for (k,) in rows(data, at(stbl, b"stss"), ">I")] if b"stss" in kinds else range(1, len(samples) + 1)
    if any(not 1 <= k <= len(samples) for k in keys):
        raise Malformed("a keyframe that is no sample")
    return {"codec": codec, "scale": scale, "seconds": length / scale if scale else None, "samples": samples, "keys": [samples[k - 1] for k in keys]}


def fragment_samples(data: memoryview, tree: list, track_id: int, defaults: tuple[int, int]) -> tuple[list, list, int]:
    """(samples, keyframes, length in units of time) of a track in the movie fragments of a file.

    defaults: duration and size of samples that a fragment doesn't state. Flags that mark a sample as no keyframe are
    read where they stand, in the run or in the fragment's header; without any, every sample is a keyframe.
    """
    samples: list[tuple[int, int]] = []
    keys: list[tuple[int, int]] = []
    length = 0
    for kind, body, _, moof in tree:
        if kind != b"moof":
            continue
        for _, _, _, traf in [x for x in moof if x[0] == b"traf"]:
            a, b = at(traf, b"tfhd")
            flags, own = struct.unpack_from(">II", data, a)
            if own != track_id:
                continue
            place, base, (duration, size), mark = a + 8, body - 8, defaults, 0
            if flags & 0x1:
                base, place = struct.unpack_from(">Q", data, place)[0], place + 8
            place += 4 * bool(flags & 0x2)
            for bit in (0x8, 0x10, 0x20):
                if flags & bit:
                    value, place = struct.unpack_from(">I", data, place)[0], place + 4
                    duration, size, mark = (value if bit == 0x8 else duration), (value if bit == 0x10 else size), (value if bit == 0x20 else mark)
            start = base
            for _, a, b, _ in [x for x in traf if x[0] == b"trun"]:
                flags, count = struct.unpack_from(">II", data, a)
                flags, place, first = flags & 0xFFFFFF, a + 8, None
                if flags & 0x1:
                    start, place = base + struct.unpack_from(">i", data, place)[0], place + 4
                if flags & 0x4:
                    first, place = struct.unpack_from(">I", data, place)[0], place + 4
                fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
                if place + 4 * len(fields) * count > b or not fields and max(size * count, len(samples) + count) > len(data):
                    raise Malformed("a run of a fragment is cut off, or has more samples than the file has bytes")
                for i in range(count):
                    told = dict(zip(fields, struct.unpack_from(f">{len(fields)}I", data, place), strict=True))
                    place += 4 * len(fields)
                    end = start + told.get(0x200, size)
                    if not 0 <= start <= end <= len(data):
                        raise Malformed("a sample of a fragment lies outside of the file")
                    samples.append((start, end))
                    if not (first if i == 0 and first is not None else told.get(0x400, mark)) & 0x10000:
                        keys.append((start, end))
                    start, length = end, length + told.get(0x100, duration)
    return samples, keys, length


def tracks(data: memoryview) -> list[dict]:
    tree = walk(data, 0, len(data))
    moov = next((inner for kind, _, _, inner in tree if kind == b"moov"), None)
    if moov is None:
        raise Malformed("no movie box")
    extends = {}
    for _, _, _, mvex in [x for x in moov if x[0] == b"mvex"]:
        for _, a, _, _ in [x for x in mvex if x[0] == b"trex"]:
            track_id, _, duration, size = struct.unpack_from(">IIII", data, a + 4)
            extends[track_id] = duration, size
    found, ids = [], set()
    for kind, _, _, trak in moov:
        if kind == b"trak":
            track = read_track(data, trak)
            if extends:
                a, b = at(trak, b"tkhd")
                track_id = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
                if track_id in ids:
                    raise Malformed("two tracks have one id")
                ids.add(track_id)
                samples, keys, length = fragment_samples(data, tree, track_id, extends.get(track_id, (0, 0)))
                track["samples"], track["keys"] = track["samples"] + samples, track["keys"] + keys
                if length and track["scale"]:
                    track["seconds"] = (track["seconds"] or 0.0) + length / track["scale"]
            found.append(track)
    return found


def read_media(file: bytes | None) -> list[dict]:
    """The tracks of a file: codec, seconds, scale, samples and keys (byte ranges). Raises Malformed, and nothing else."""
    try:
        return tracks(memoryview(file or b""))
    except (struct.error, IndexError, MemoryError) as e:  # a box or a table ends before what it should hold
        raise Malformed(f"cut off: {e}") from e


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes with zeros up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % UNIT if raw else UNIT)


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [T.StructField("codec", T.StringType()), T.StructField("seconds", T.DoubleType()), T.StructField("n_samples", T.LongType()), T.StructField("keyframes", SPAN), T.StructField("error", T.StringType())]


def media_columns(df: DataFrame, file: str = "media") -> DataFrame:
    """`df` with codec, seconds, n_samples, keyframes (byte ranges) and error of the first track of each file."""
    names = [f.name for f in FIELDS]
    keep = [f.name for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*[f for f in df.schema.fields if f.name in keep], *FIELDS])
    kinds = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def facts(data):
        try:
            tracks = read_media(data)
            if not tracks:
                raise Malformed("no track")
            t = tracks[0]
            return t["codec"], t["seconds"], len(t["samples"]), [{"start": a, "end": b} for a, b in t["keys"]], None
        except Malformed as e:
            return None, None, None, None, str(e)

    def run(batches):
        for batch in batches:
            found = list(zip(*map(facts, batch.column(file).to_pylist()), strict=True)) or [()] * len(FIELDS)
            types = [pa.string(), pa.float64(), pa.int64(), pa.list_(kinds), pa.string()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], *[pa.array(x, t) for x, t in zip(found, types, strict=True)]], names=[*keep, *names])

    return df.mapInArrow(run, schema)


def stored_texts(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """`df` with a media file that holds each text, padded."""
    keep = [f.name for f in df.schema.fields if f.name != out]
    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, T.BinaryType())])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                files = pa.array([write_media(padded(x)[1]) for x in part.column(text).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], files], names=[*keep, out])

    return df.mapInArrow(run, schema)


DIGEST = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def media_digest(docs: DataFrame) -> DataFrame:
    """Each text stored as a file and read back through its sample tables: sizes, digests and what the tables say."""

    def digest(doc_id, text):
        n, payload = padded(text)
        file = write_media(payload)
        track = read_media(file)[0]
        back, view = hashlib.sha256(), memoryview(file)
        size, tail = 0, b""
        spans = track["samples"]
        i = 0
        while i < len(spans):  # neighbouring samples are read at once
            j = i
            while j + 1 < len(spans) and spans[j + 1][0] == spans[j][1]:
                j += 1
            piece = view[spans[i][0] : spans[j][1]]
            back.update(piece)
            size, tail, i = size + len(piece), (tail + bytes(piece[-UNIT:]))[-UNIT:], j + 1
        keys = track["keys"]
        feature = f"codec={track['codec'].strip()};seconds={track['seconds']:.6f};samples={len(spans)};keyframes={len(keys)};first={keys[0][0]}-{keys[0][1]};last={keys[-1][0]}-{keys[-1][1]}"
        return doc_id, n, size, back.hexdigest(), zlib.crc32(tail), len(file), hashlib.sha256(file).hexdigest(), feature

    def run(batches):
        for batch in batches:
            out = list(zip(*(digest(i, t.as_py()) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)), strict=True)) or [()] * len(DIGEST)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(out, DIGEST, strict=True)], names=[k for k, _ in DIGEST])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
