import hashlib
import random
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import media


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 300])
def test_round_trip(n):
    payload = bytes(i * 7 % 256 for i in range(64 * n))
    track = media.read_media(media.write_media(payload))[0]
    file = media.write_media(payload)
    assert b"".join(file[a:b] for a, b in track["samples"]) == payload and track["codec"] == "raw " and track["seconds"] == 64 * n / media.RATE
    assert track["keys"] == track["samples"][:: media.KEY_EVERY]


def test_other_layouts_are_read():
    """Sizes one by one, several chunk runs, long boxes, 64-bit offsets, no sync table, version 1 times."""
    stbl = media.box(
        b"stbl",
        media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(70))),
        media.full(b"stts", media.table(">II", [(2, 5), (3, 7)])),
        media.full(b"stsc", media.table(">III", [(1, 2, 1), (2, 1, 1), (3, 2, 1)])),
        media.full(b"stsz", struct.pack(">I", 0), media.table(">I", [(3,), (4,), (5,), (6,), (7,)])),
        media.full(b"co64", media.table(">Q", [(8,), (100,), (50,)])),
    )
    mdhd = media.box(b"mdhd", b"\1" + bytes(3), struct.pack(">QQIQ", 0, 0, 1000, 31000), bytes(4))
    moov = media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", stbl))))
    file = struct.pack(">I4sQ", 1, b"free", 200) + bytes(184) + moov
    track = media.read_media(file)[0]
    assert track["samples"] == [(8, 11), (11, 15), (100, 105), (50, 56), (56, 63)] == track["keys"] and track["codec"] == "avc1" and track["seconds"] == 31.0


def test_broken_files_give_errors(spark):
    good = media.write_media(bytes(640))
    files = [good, None, b"", b"abc", good[:100], good[:-1], good.replace(b"stsz", b"stsx"), good.replace(b"stco", b"free"), b"\0\0\0\0moov"]
    df = spark.createDataFrame([(i, f, "x") for i, f in enumerate(files)], "id int, media binary, codec string")
    rows = sorted(media.media_columns(df).collect())
    assert [r.error is None for r in rows] == [True] + [False] * 8
    assert rows[0].codec == "raw " and rows[0].n_samples == 10 and [(k.start, k.end) for k in rows[0].keyframes] == [(len(good) - 640, len(good) - 576)]


def test_digest(docs):
    texts = [None, "", "a", "é" * 32, "x" * 64, "y" * 65, "z" * 200_000, "a"]
    rows = {r.doc_id: r for r in media.media_digest(docs(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        file = media.write_media(payload)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    assert rows[2][1:] == rows[7][1:] and media.media_digest(docs([])).count() == 0
    stored = media.media_columns(media.stored_texts(docs(list(enumerate(texts))).withColumn("media", F.lit(1)))).collect()
    assert all(r.error is None for r in stored)


def fragmented(sizes, flags=0):
    """A file whose movie box has no samples, and a fragment with one run."""
    stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"mp4a", bytes(28))), *[media.full(k, bytes(4)) for k in (b"stts", b"stsc", b"stco")], media.full(b"stsz", bytes(8)))
    mdia = media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), media.box(b"minf", stbl))
    trak = media.box(b"trak", media.full(b"tkhd", struct.pack(">IIIII", 0, 0, 7, 0, 0)), mdia)
    moov = media.box(b"moov", trak, media.box(b"mvex", media.full(b"trex", struct.pack(">IIIII", 7, 1, 20, 5, 0))))

    def moof(offset):
        run = b"".join(struct.pack(">II", n, 0 if i % 2 == 0 else 0x10000) for i, n in enumerate(sizes))
        trun = media.box(b"trun", struct.pack(">IIi", 0x601, len(sizes), offset), run)
        return media.box(b"moof", media.full(b"mfhd", struct.pack(">I", 1)), media.box(b"traf", media.box(b"tfhd", struct.pack(">II", flags, 7)), trun))

    return moov + moof(len(moof(0)) + 8) + media.box(b"mdat", bytes(sum(sizes))), len(moov) + len(moof(0)) + 8


def test_fragments_give_samples():
    file, start = fragmented([3, 4, 5])
    track = media.read_media(file)[0]
    assert track["samples"] == [(start, start + 3), (start + 3, start + 7), (start + 7, start + 12)]
    assert track["keys"] == [(start, start + 3), (start + 7, start + 12)] and track["seconds"] == pytest.approx(0.06) and track["codec"] == "mp4a"


def test_cut_and_changed_files_never_fail(spark):
    """Every cut and many changed bytes give tracks or Malformed; a table of such files gives an `error`, no failed task."""
    rng = random.Random(8)
    files = []
    for good in (media.write_media(bytes(64 * 3)), fragmented([3, 4, 5])[0]):
        files += [good[:n] for n in range(0, len(good), 3)]
        for _ in range(1500):
            bad = bytearray(good)
            for _ in range(rng.randint(1, 4)):
                bad[rng.randrange(len(bad))] = rng.choice([0, 1, 0x7F, 0xFF, rng.randrange(256)])
            files.append(bytes(bad))
    deep = b""
    for _ in range(3000):
        deep = media.box(b"moof", deep)
    files += [deep, media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full(b"mdhd"), media.box(b"minf", media.box(b"stbl")))))]
    for f in files:
        try:
            for track in media.read_media(f):
                assert all(0 <= a <= b <= len(f) for a, b in track["samples"])
        except media.Malformed:
            pass
    rows = media.media_columns(spark.createDataFrame([(f,) for f in files[-300:]], "media binary")).collect()
    assert len(rows) == 300 and all((r.error is None) == (r.codec is not None) for r in rows)


def test_huge_counts_are_not_trusted():
    good = media.write_media(bytes(640))
    at = good.index(b"stsz") + 8
    with pytest.raises(media.Malformed):
        media.read_media(good[:at] + struct.pack(">II", 1, 0xFFFFFFFF) + good[at + 8 :])


@pytest.mark.parametrize("count", [2_000_000, 0xFFFFFFFF])
@pytest.mark.parametrize("runs", [1, 40])
def test_runs_of_empty_samples_are_bounded_by_the_file(count, runs):
    """A run without fields and with samples of no bytes could claim any number of them."""
    good = fragmented([3, 4, 5])[0]
    moov = good[: good.index(b"moof") - 4].replace(struct.pack(">IIIII", 7, 1, 20, 5, 0), struct.pack(">IIIII", 7, 1, 20, 0, 0))
    run = media.box(b"trun", struct.pack(">II", 0, count if runs == 1 else len(moov)))
    file = moov + media.box(b"moof", media.full(b"mfhd", struct.pack(">I", 1)), media.box(b"traf", media.box(b"tfhd", struct.pack(">II", 0, 7)), *[run] * runs))
    began = time.perf_counter()
    with pytest.raises(media.Malformed):
        media.read_media(file)
    assert time.perf_counter() - began < 0.1


def test_tracks_of_one_id_are_refused():
    good = fragmented([3, 4, 5])[0]
    start = good.index(b"trak") - 4
    trak = good[start : start + struct.unpack_from(">I", good, start)[0]]
    moov = struct.unpack_from(">I", good, 0)[0]
    file = struct.pack(">I", moov + len(trak)) + good[4:8] + trak + good[8:]
    with pytest.raises(media.Malformed, match="one id"):
        media.read_media(file)
