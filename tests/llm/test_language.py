import random
import unicodedata
import zlib
from collections import Counter

import duckdb
import pytest

from gridloom.llm import language
from gridloom.llm.queries import op12_language_id

WORDS = {"aa": "the and of with under river", "bb": "les des été où ça forêt", "cc": "ночь и день река мир", "": "zz zzz zzzz zzzzz"}


def grams(text):
    words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text or "").lower().split()
    for w in words:
        yield from w
        for size in (2, 3):
            yield from (f" {w} "[i : i + size] for i in range(len(w) + 3 - size))
    return


def key(gram):
    return sum(ord(c) << 21 * i for i, c in enumerate(gram))


def ranked(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], key(x[0])))[:size]]


def brute(rows, size):
    """(doc_id, held_out, lang_pred, score) by the definition, one n-gram at a time."""
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0 for i, _, _ in rows]
    sums = {}
    for (_, text, lang), out in zip(rows, held, strict=True):
        if not out and lang is not None and text is not None:
            sums.setdefault(lang, Counter()).update(grams(text))
    learned = {lang: {g: i for i, g in enumerate(ranked(c, size))} for lang, c in sums.items() if c}
    for (i, text, _), out in zip(rows, held, strict=True):
        own = ranked(Counter(grams(text)), size)
        best = min(((sum(abs(p[g] - k) if g in p else size for k, g in enumerate(own)), lang.encode()) for lang, p in learned.items()), default=None) if own else None
        yield (i, out, best[1].decode(), 1 - best[0] / (size * len(own))) if best else (i, out, "und", 0.0)


def sample(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", ",", "-9", "\n"]) for _ in range(rng.randint(1, 40))), rng.choice([lang, lang, lang, None])))
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (None, "les des été", "bb"), (7, "THE River", "aa"), (7, "THE River", "aa"), (1003, "ａ𝒳 Ǆ", "aa"), (1004, "ét", None)]
    return rows


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("size", "slices", "held", "at_once"), [(300, 1 << 20, 1 << 20, 512), (20, 7, 10, 512), (20, 1, 1, 1)])
def test_against_brute_force(spark, monkeypatch, size, slices, held, at_once):
    monkeypatch.setattr(language, "SLICE", slices)
    monkeypatch.setattr(language, "HELD", held)
    monkeypatch.setattr(language, "LANGUAGES", at_once)
    rows = sample(size)
    df = spark.createDataFrame([(*r, "clash", "x") for r in rows], "doc_id long, text string, lang string, lang_pred string, score string").repartition(3)
    learned = language.profiles(df.filter(~language.held_out()), size)
    got = language.identify(df, learned, size).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")
    assert rows_of(got) == sorted(brute(rows, size), key=repr)


@pytest.mark.parametrize("text", ["ab " * 50 + "z" * 40 + " c", "", " ", "a", "é" * 100])
def test_slices_lose_no_gram(monkeypatch, text):
    want = Counter(key(g) for g in grams(text))
    for size in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(language, "SLICE", size)
        keys, counts = language.counted(text)
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want or not text.strip()


def test_nothing_to_learn_and_empty_tables(spark, docs):
    blank = spark.createDataFrame([(1, "the river", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.document_languages(blank).collect()} == {("und", 0.0)}
    assert language.document_languages(docs([(1, "x")]).limit(0)).count() == 0


def test_query_equals_sql_and_is_right_on_held_out_rows(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, held_out, lang_pred, score FROM ({language.LANGUAGE_SQL})").fetchall()
    got = op12_language_id(spark, sf).cache()
    assert rows_of(got.select("doc_id", "held_out", "lang_pred", "score")) == sorted(want, key=repr)
    met = got.filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert met and sum(r.lang == r.lang_pred for r in met) >= 0.98 * len(met)
