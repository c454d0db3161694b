import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import ngram_join as nj

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def grams(text, n):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, num, den):
    """Components by comparing all pairs."""
    sets, root = [grams(t, n) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if sets[i] and ids else doc))
    return sorted(out, key=str)


def corpus(seed, families=25):
    """Families of near copies at all distances, of short and long texts, with shared passages."""
    rng, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(4000)]
    passage = rng.choices(words, k=60)
    for f in range(families):
        base = rng.choices(words, k=rng.choice([3, 5, 8, 12, 20, 40, 80, 200, 500]))
        if f % 4 == 0:
            base = base + passage
        for _ in range(rng.choice([1, 2, 4, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 2)] = rng.choices(words, k=rng.randint(0, 2))
            rows.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in copy))
    return list(enumerate(rows))


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_components_against_all_pairs(docs, n, num, den):
    rows = [*corpus(n), (900, None), (901, ""), (902, " \n"), (None, "one two three four five six"), (None, "only here is this text found"), (903, "ONE two three four five six"), (904, "a b"), (905, "A\tb"), (3, "same id but another text is here"), (906, "É b c d e f g"), (907, "é b c d e f g")]
    got = nj.near_duplicates(docs(rows), n, num, den).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, n, num, den)


@pytest.mark.parametrize(("num", "den"), [(1, 10), (3, 10), (1, 2), (7, 10), (1, 1)])
def test_all_thresholds_against_all_pairs(docs, num, den):
    rows = corpus(num + den, 12)
    got = nj.near_duplicates(docs(rows), 2, num, den).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 2, num, den)


@pytest.mark.parametrize(("task_grams", "task_sets", "num"), [(300, 3, 85), (100_000, 5, 85), (300, 3, 40)])
def test_large_blocks_are_dealt_over_tasks(docs, task_grams, task_sets, num):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    hot = [" ".join(base[:a] + [f"x{rng.randrange(20)}"] + base[a + rng.choice([0, 1, 6, 12]) :]) for a in (rng.randrange(70) for _ in range(90))]
    rows = [*corpus(11, 15), *enumerate(hot, 5000)]
    got = nj.near_duplicates(docs(rows), 4, num, 100, task_grams, task_sets).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 4, num, 100)


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_whole_table_against_an_inverted_index(spark, n, num, den):
    """All documents of sf0.01 against plain Python, which counts overlaps by an inverted index."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    sets, holders, root = [grams(t, n) for _, t in rows], {}, list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in enumerate(sets):
        for g in own:
            holders.setdefault(g, []).append(i)
    for i, own in enumerate(sets):
        for j, both in Counter(j for g in own for j in holders[g] if j < i).items():
            if den * both >= num * (len(own) + len(sets[j]) - both):
                root[find(i)] = find(j)
    first = {}
    for i, (doc, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), doc), doc)
    want = sorted((doc, len(sets[i]), first[find(i)]) for i, (doc, _) in enumerate(rows))
    assert sorted(map(tuple, nj.near_duplicates(docs, n, num, den).select("doc_id", "n_shingles", "component_id").collect())) == want
    assert len({w[2] for w in want}) < len(want)


@pytest.mark.parametrize(("num", "den"), [(1, 10), (3, 10), (2, 5), (1, 2), (4, 5), (85, 100), (1, 1)])
def test_tries_find_links_at_exactly_the_threshold(num, den):
    rng, t = np.random.default_rng(7), nj.Threshold(num, den)
    for _ in range(600):
        a = int(rng.integers(1, 60))
        b = int(rng.integers(a, a * den // num + 1))
        both = t.needed(a, b)
        if both > a:
            continue
        pool = rng.permutation(10_000)[: a + b].astype(np.uint64)
        x, y = np.sort(pool[:a]), np.sort(np.concatenate([pool[:both], pool[a : a + b - both]]))
        label = nj.components_of(t, [x, np.arange(20_000, 20_010, dtype=np.uint64), y], np.array([a, 10, b]))
        assert label[0] == label[2] != label[1]


@pytest.mark.parametrize(("num", "den"), [(1, 5), (1, 2), (4, 5)])
def test_tries_find_all_links(num, den):
    rng, t = np.random.default_rng(5), nj.Threshold(num, den)
    sets = []
    for _ in range(20):
        base = rng.integers(0, 300, 30).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[rng.random(30) < 0.93], rng.integers(0, 300, 1).astype(np.uint64)])) for _ in range(8)]
    trie = nj.Trie(t, sets, np.array([len(s) for s in sets]))
    sets = [sets[i] for i in trie.order]
    for i, s in enumerate(sets):
        want = {j for j, o in enumerate(sets) if j != i and den * len(np.intersect1d(s, o)) >= num * len(np.union1d(s, o))}
        assert set(trie.links(i, np.arange(len(sets)) != i).tolist()) == want


def test_thresholds_are_fractions():
    for num, den in ((0, 1), (3, 2), (-1, 2)):
        with pytest.raises(ValueError, match="threshold"):
            nj.Threshold(num, den)


def test_classes_keep_the_order_of_frequencies():
    got = nj.frequency_class(np.array([1, 2, 3, 32, 33, 64, 65, 10**6, 10**12]))
    assert got[0] == 0 and got[1] == 1 and (np.diff(got.astype(int)) >= 0).all() and got.max() <= 63


def test_words_are_split_by_ascii_space_only():
    texts = ["  a\x0bb\x0c c\r\n", "a b c d", "\x1ca \x85b", None, "x" * 100_000 + " y"]
    for text, got in zip(texts, nj.gram_sets(pa.array(texts), 1), strict=True):
        assert len(got) == len(set(WORDS.findall(text or "")))


def test_keep_one(docs):
    rows = [(4, "a b c d e f g h"), (2, "A b c d e f g h"), (9, "quite another text of its own here"), (7, None), (8, ""), (9, "quite another text of its own here"), (None, "the only text that has no id at all")]
    own = ["group", "_id", "_Key", "_copies", "_text", "key", "text_key", "copies", "s1", "node", "_n"]
    kept = nj.keep_one(docs(rows).withColumns({c: F.lit("mine") for c in own}))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", *own]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 7, 8, 9, None]
    assert nj.keep_one(docs([])).count() == 0


def test_slices_of_a_batch_read_as_whole_texts():
    texts = pa.array([f"É ü Wort{i} zwei drei" for i in range(700)])
    for a, b in zip(nj.gram_sets(texts.slice(512), 2), nj.gram_sets(pa.array(texts.to_pylist()[512:]), 2), strict=True):
        assert (a == b).all()


def test_walks_leave_subtrees_that_cannot_reach_the_threshold(monkeypatch):
    """Sets with enough early n-grams in common but too little after them are met, and dropped before their ends."""
    t = nj.Threshold(4, 5)
    base = np.arange(1000, 1400, dtype=np.uint64)
    far = [np.concatenate([base[:90], np.arange(5000 + 400 * i, 5310 + 400 * i, dtype=np.uint64)]) for i in range(20)]
    trie = nj.Trie(t, [base, *far, base.copy()[:380]], np.array([400] * 21 + [380]))
    me = int(np.flatnonzero(trie.order == 0)[0])
    read, plain = [], nj.pieces
    monkeypatch.setattr(nj, "pieces", lambda starts, lengths: read.append(int(lengths.sum())) or plain(starts, lengths))
    found = trie.links(me, np.arange(22) != me)
    assert trie.order[found].tolist() == [21]
    entered = sum(trie.length) - trie.length[me]
    assert sum(read[1:]) < entered / 4  # n-grams of the branches walked, of all that the other sets hold
