"""Every stage against a plain version of it, on what the stage before has kept."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from corpus_pipeline import COLUMNS, STAGES
from tests.llm import test_bpe, test_line_dedup, test_mixing, test_ngram_join, test_quality


def good(docs, labels):
    """Ids that Bayes' rule keeps, with evidence, posteriors and models by plain loops."""
    known = [(docs[i].text, (int(q <= 0), int(t > 0))) for i, q, t in labels if i in docs]
    order = sorted(docs)
    evidence = test_quality.plain_evidence(known, [docs[i].text for i in order])
    posteriors = test_quality.bayes([(docs[i].source, docs[i].lang, float(e)) for i, e in zip(order, evidence, strict=True)])
    return {i for i, (_, p) in zip(order, posteriors, strict=True) if p >= 0.5}


def test_stages_in_turn(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    docs, kept = {r.doc_id: r for r in frame.collect()}, []
    for _, stage in STAGES[:-1]:
        frame = stage(spark, frame, sf).cache()
        assert tuple(frame.columns) == COLUMNS
        kept.append(frame.collect())
    quality, lines, near, mix = kept
    assert {r.doc_id for r in quality} == good(docs, labels) and {(r.doc_id, r.text) for r in quality} <= {(r.doc_id, r.text) for r in docs.values()}

    want = {i: (text, dropped) for i, _, dropped, text in test_line_dedup.brute([(r.doc_id, r.text) for r in quality])}
    assert {r.doc_id: r.text or "" for r in lines} == {i: text for i, (text, _) in want.items()}
    assert all(r.n_chars == (len(r.text) if want[r.doc_id][1] else docs[r.doc_id].n_chars) for r in lines)

    groups = test_ngram_join.brute([(r.doc_id, r.text) for r in lines], 5, 4, 5)
    assert {r.doc_id for r in near} == {component if n else doc for doc, n, component in groups} and len(near) < len(lines)
    assert set(near) <= set(lines)

    size = {r.doc_id: len(test_mixing.WORDS.findall(r.text or "")) for r in near}
    sources, taken, source_of = defaultdict(int), Counter(r.doc_id for r in mix), {r.doc_id: r.source for r in near}
    for i, n in size.items():
        sources[source_of[i]] += n
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sources))}
    targets = test_mixing.filled(sources, weights, 1.5, 2.0)
    for s in sources:
        assert abs(sum(size[i] * n for i, n in taken.items() if source_of[i] == s) - targets[s]) <= max(size.values()) / 2 + 1
    assert set(mix) <= set(near) and max(taken.values()) <= 2

    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in out) == taken
    texts = {r.doc_id: r.text or "" for r in near}
    ids = {i: test_bpe.LIB.encode(texts[i], add_special_tokens=False).ids for i in taken}
    assert all(list(r.ids) == ids[r.doc_id] and r.n_tokens == len(r.ids) for r in out)


def test_empty_documents(spark, sf, docs):
    frame = docs([])
    for _, stage in STAGES:
        frame = stage(spark, frame, sf)
        assert frame.count() == 0


@pytest.mark.parametrize("name", ["evidence", "_key", "copies"])
def test_stages_keep_the_columns_of_documents(spark, sf, docs, name):
    frame = docs([(1, "a b c d e f"), (2, None), (3, "")]).withColumn(name, corpus_pipeline.F.lit("mine"))
    for _, stage in STAGES[:-1]:
        assert tuple(stage(spark, frame, sf).columns) == COLUMNS
