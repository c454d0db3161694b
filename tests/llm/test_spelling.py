import random
import zlib
from collections import Counter

import duckdb
import pytest

from gridloom.llm import spelling
from gridloom.llm.queries import op11_spelling_variants

LETTERS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | {chr(c) for c in range(0xC0, 0x100)}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text):
    run = ""
    for c in (text or "") + " ":
        if c in LETTERS:
            run += c
        elif run:
            yield run.translate(LOWER)
            run = ""


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in runs(text):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_forms(n, ratio=10):
    found = {}
    for w in n:
        others = [v for v in n if near(v, w)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        found[w] = (best if best is not None and n[best] >= ratio * n[w] else None, len(others))
    out = []
    for w, (form, others) in found.items():
        root = w
        while found[root][0] is not None:
            root = found[root][0]
        out.append((w, form, root, n[w], others, None if form is None else n[form]))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def random_words(seed, size, letters):
    rng, n = random.Random(seed), {}
    while len(n) < size:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(7, 12)))
        for _ in range(rng.randint(1, 6)):
            n.setdefault(w, rng.choice([2, 2, 3, 20, 30, 250, 4000]))
            at, c = rng.randrange(len(w)), rng.choice(letters)
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :], w + c, c + w])
    return n


@pytest.mark.parametrize(("seed", "size", "letters", "most"), [(1, 250, "ab", 4), (2, 400, "abcé", 128), (3, 300, "abcdefg", 2)])
def test_against_all_pairs(spark, monkeypatch, seed, size, letters, most):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", most)
    n = random_words(seed, size, letters)
    df = spark.createDataFrame([(w, k, "clash") for w, k in n.items()], "word string, n long, near string")
    assert rows_of(spelling.spelling_forms(df)) == brute_forms(n)


@pytest.mark.parametrize("chars", [1, 1 << 16])
def test_places_at_both_ends_and_long_words(spark, monkeypatch, chars):
    monkeypatch.setattr(spelling, "BLOCK_CHARS", chars)
    base, long = "abcdefgh", "xyz" * 3000
    n = {base: 2000, "zabcdefgh": 30, "abcdefghz": 200, "bcdefgh": 7, "abcdefg": 3, "abcdxfgh": 2, "abcdefghzz": 2, "aaaaaaaa": 5, "aaaaaaaaa": 50, "aaaaaaa": 5, long: 40, long + "x": 2, long[1:]: 3, long[:4000] + "q" + long[4001:]: 4}
    assert rows_of(spelling.spelling_forms(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute_forms(n)


def test_documents_against_brute_force(spark, docs):
    rng = random.Random(5)
    words = [w.capitalize() if i % 3 else w for i, w in enumerate(random_words(9, 60, "abcèÿ×"))]
    texts = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(20)]
    texts += [(90, None), (91, ""), (92, "short Ωμέγα 12345678"), (3, texts[3][1]), (93, "a-" * 70000 + "ABCDEFGH" * 3)]
    df = docs(texts).withColumn("word", spelling.F.lit("clash")).withColumn("n", spelling.F.lit(1))
    assert rows_of(spelling.document_spellings(df)) == brute_forms(brute_words(texts))


def test_null_ids_repeats_and_empty_tables(spark, docs):
    rows = [(None, "Ångström ångström Ångström"), (None, "ångström")]
    assert rows_of(spelling.document_spellings(docs(rows))) == brute_forms(brute_words(rows))
    assert spelling.document_spellings(docs([(1, "x")]).limit(0)).count() == 0
    df = spark.createDataFrame([("wordword", 2), ("wordword", 3), (None, 4), ("wordwort", None), ("wordwore", 60)], "word string, n long")
    assert rows_of(spelling.spelling_forms(df)) == [("wordword", "wordwore", "wordwore", 5, 1, 60), ("wordwore", None, "wordwore", 60, 1, None)]
    with pytest.raises(ValueError, match="more often"):
        spelling.spelling_forms(df, 1)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({spelling.SPELLING_SQL})").fetchall()
    assert rows_of(op11_spelling_variants(spark, sf)) == sorted(want)
