import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import bpe
from gridloom.llm.queries import queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB, OWN = Tokenizer.from_file(PATH), bpe.Codec(PATH)


def same(text):
    ids = LIB.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids and OWN.decode(ids) == LIB.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    same(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "é", "<|endoftext|>", "'s", "'", "12", "!!", "=", "　", "🙂", "\x1c", "\x85"]), max_size=60))
def test_hard_mixes(parts):
    same("".join(parts))


def test_words_longer_than_any_slice():
    rng = random.Random(5)
    for n in (300, 70_000):
        same("a" * n)
        same("".join(rng.choice("aehinrst") for _ in range(n // 10)))
        same("=" * n + " " * n + "x")


def test_contractions_at_every_slice_border(monkeypatch):
    same("a " * 32766 + "we'll stay ")
    texts = ["we'll", "we're so", "we've 'll", "'l 'r 'v 've", "it's I'm I'd !'ll ''re 'lla", "x  'll\n\n'v 'v\n y", "'", "''", "'r"]
    for width in range(1, 9):
        monkeypatch.setattr(bpe, "SLICE", width)
        for text in texts:
            for shift in range(width):
                same("b" * shift + text)
                same(" " * shift + text + " z")


def test_transducer_holds_little_and_fits_any_split():
    rng, word = random.Random(1), bytes(random.Random(2).choice(b"etaoinshr") for _ in range(3_000))
    t, out, at, most = bpe.Transducer(OWN.m), [], 0, 0
    while at < len(word):
        n = rng.randint(1, 400)
        out += t.feed(word[at : at + n])
        at, most = at + n, max(most, len(t.data))
    assert out + t.finish() == [OWN.m.ids[x] for x in OWN.m.merged(word)] and most <= 16 * OWN.m.longest


def test_neighbours_rule_agrees_with_merging():
    rng, m = random.Random(3), OWN.m
    tokens = sorted(m.ids.values())
    assert m.proper
    for _ in range(4000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if m.alone[a] and m.alone[b]:
            assert m.stays[a * m.size + b] == (m.merged(m.bytes[a] + m.bytes[b]) == [m.bytes[a], m.bytes[b]])


def test_every_split_of_hard_texts(monkeypatch):
    parts = ["'s", "'t", "'re", "'ve", "'ll", "'m", "'d", "'", " ", "  ", "\n\n", "word", "12345678901234567890", "!!!!!!!!", "<|endoftext|>", "é🙂", " " * 40, "=" * 70, "aehinrst" * 9]
    rng = random.Random(9)
    texts = ["".join(rng.choices(parts, k=12)) for _ in range(25)]
    for width in (2, 3, 5, 8, 13, 16, 17, 31, 64):
        monkeypatch.setattr(bpe, "SLICE", width)
        for text in texts:
            same(text)


def test_a_word_of_millions_of_letters_runs_in_flat_memory(monkeypatch):
    rng = random.Random(4)
    word = "".join(rng.choice("etaoinshr") for _ in range(2_000_000))
    most, feed = [0], bpe.Transducer.feed

    def watched(self, piece):
        most[0] = max(most[0], len(piece) + len(self.data))
        return feed(self, piece)

    monkeypatch.setattr(bpe.Transducer, "feed", watched)
    longest, out = 0, []
    for ids in OWN.pieces(word):
        longest = max(longest, len(ids))
        out += ids
    assert OWN.decode(out) == word and longest <= bpe.SLICE and most[0] < 2 * bpe.SLICE
    assert out[:9_000] == LIB.encode(word[:60_000], add_special_tokens=False).ids[:9_000]


def test_whole_table_against_the_library(spark):
    """Every column of the query over all documents of sf0.01."""
    path = "/root/testdata/sf0.01"
    want = set()
    for d in spark.read.parquet(f"{path}/documents.parquet").collect():
        ids = LIB.encode(d.text or "", add_special_tokens=False).ids
        decoded = LIB.decode(ids, skip_special_tokens=False)
        want.add((d.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert {tuple(r) for r in queries()["op7_bpe_round_trip"](spark, path).collect()} == want


def test_columns(docs):
    texts = [None, "", "Hello world", "<|endoftext|>x", "x" * 5000]
    df = docs(list(enumerate(texts))).withColumn("ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(df))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"]
    digest = {r.doc_id: r for r in bpe.round_trip_digest(docs(list(enumerate(texts)))).collect()}
    for r in out.collect():
        assert r.ids == LIB.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
        d = digest[r.doc_id]
        assert d.n_tokens == len(r.ids) and d.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert d.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode(docs([])).count() == 0
    plain = bpe.encode(docs([(1, "<|endoftext|>")]), specials=False).first().ids
    assert 50256 not in plain
    slim = bpe.encode(df, keep_text=False)
    assert slim.columns == ["doc_id", "lang", "source", "n_chars", "ids"]
    assert {r.doc_id: r.ids for r in slim.collect()} == {r.doc_id: r.ids for r in out.collect()}
