import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import quality
from gridloom.llm.queries import queries


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    known = labels.filter("doc_id % 4 <> 1")
    asked = labels.filter("doc_id % 4 = 1")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = quality.classify(docs.join(asked.select("doc_id"), "doc_id", "left_semi").union(docs.join(known.select("doc_id"), "doc_id", "left_semi")), known)
    rows = got.join(asked, "doc_id").collect()
    clean = [r.keep for r in rows if r.quality == 1 and r.toxic == 0]
    toxic = [r.keep for r in rows if r.toxic == 1]
    poor = [r.keep for r in rows if r.quality == 0]
    assert len(clean) > 500 and sum(clean) >= 0.995 * len(clean)
    assert sum(toxic) <= 0.02 * len(toxic) and sum(poor) <= 0.01 * len(poor)


def bayes(rows):
    """(host, path, evidence) -> [(site_rate, posterior)], by plain loops over all other documents."""
    rate = min(max(sum(e for *_, e in rows) / len(rows), 1e-6), 1 - 1e-6)

    def strength(groups):
        size = sum(len(v) for v, _ in groups)
        beyond = (sum(len(v) * (sum(v) / len(v) - prior) ** 2 for v, prior in groups) - sum(p * (1 - p) for _, p in groups)) / size
        return min(max(rate * (1 - rate) / max(beyond, 1e-9) - 1, 1.0), 1e6)

    hosts, paths = {}, {}
    for h, p, e in rows:
        hosts.setdefault(h, []).append(e)
        paths.setdefault((h, p), []).append(e)
    k0 = strength([(v, rate) for v in hosts.values()])
    k1 = strength([(v, (k0 * rate + sum(hosts[h])) / (k0 + len(hosts[h]))) for (h, _), v in paths.items()])
    logit = lambda x: math.log(min(max(x, 1e-9), 1 - 1e-9) / (1 - min(max(x, 1e-9), 1 - 1e-9)))
    out = []
    for h, p, e in rows:
        above = (k0 * rate + max(sum(hosts[h]) - e, 0)) / (k0 + len(hosts[h]) - 1)
        site = (k1 * above + max(sum(paths[h, p]) - e, 0)) / (k1 + len(paths[h, p]) - 1)
        out.append((site, 1 / (1 + math.exp(-(logit(e) + logit(site) - logit(rate))))))
    return out


def test_posteriors_of_the_query_against_plain_loops(spark):
    got = queries()["op3_quality_classifier"](spark, "/root/testdata/sf0.01").orderBy("doc_id").collect()
    assert len(got) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    for r, (site, posterior) in zip(got, bayes([(r.host, r.path, r.evidence) for r in got]), strict=True):
        assert r.site_rate == pytest.approx(site, abs=1e-6) and r.posterior == pytest.approx(posterior, abs=1e-6) and r.keep == (r.posterior >= quality.KEEP)


def test_sparse_sites_stay_near_their_prior(spark):
    rows = [("big", "a", 0.9)] * 50 + [("big", "b", 0.9)] * 50 + [("bad", "a", 0.1)] * 50 + [("bad", "tiny", 0.9)] + [("new", None, 0.0)] + [(None, "x", 0.9)]
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "host string, path string, evidence double, i int").withColumns({c: F.lit("mine") for c in ("n", "s", "hn", "k0", "rate", "_n", "_host", "posterior")})
    got = quality.with_posterior(table, quality.sites(table), "host", "path").orderBy("i").collect()
    for r, (site, posterior) in zip(got, bayes(rows), strict=True):
        assert r.site_rate == pytest.approx(site) and r.posterior == pytest.approx(posterior) and (r.n, r._n, r.rate) == ("mine",) * 3
    total = sum(r[2] for r in rows) / len(rows)
    assert got[0].site_rate > 0.8 and got[100].site_rate < 0.2
    # The only document of a site gets its host's rate, whatever its own evidence.
    assert got[150].site_rate < 0.3 and got[151].site_rate == pytest.approx(total, abs=0.01) == got[152].site_rate


def test_edges(spark, docs):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    rows = docs([(1, None), (2, ""), (2, "word " * 30000), (None, "x", None)]).withColumns({c: F.lit("mine") for c in ("evidence", "posterior", "site_rate", "_h", "_p", "_Rate", "host", "path", "n", "s", "hn", "hs", "k0", "k1", "rate", "_n", "c0", "c1", "turn", "low")})
    assert quality.keep_good(rows, labels).columns == rows.columns and quality.keep_good(rows, labels).count() == 4
    known = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(rows, known).collect()
    kept = quality.keep_good(rows, known)
    assert kept.columns == rows.columns and {(r.c0, r.host, r.evidence) for r in kept.collect()} <= {("mine",) * 3}
    assert len(got) == 4 and all(0 <= r.posterior <= 1 for r in got)
    assert quality.classify(docs([]), known).count() == 0


def test_long_texts_and_repeated_ids_are_learned_from(spark, docs):
    rows = [(i, ("bad awful worse " if i % 2 else "good fine better ") * (4_000 if i < 6 else 4)) for i in range(40)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(6)] + [(1, 0, 0), (900, 1, 1)], "doc_id long, quality int, toxic int")
    table = docs([*rows, *[(1, rows[1][1])] * 50])
    assert quality.labelled(table, labels, 100).count() == 7
    one, two = quality.fitted(table, labels), quality.fitted(table.repartition(7), labels)
    assert all((a == b).all() for a, b in zip(one.heads + one.odds, two.heads + two.odds, strict=True))
    got = {r.doc_id: r.evidence for r in quality.classify(table, labels).collect()}
    assert min(got[i] for i in range(0, 40, 2)) > max(got[i] for i in range(1, 40, 2))


def plain_evidence(known, asked):
    """Evidence by plain loops: known are (text, (low, toxic)) rows. Word log-odds leave the own row out for the regression only."""
    features = lambda text: [set(quality.word_slots(w)) - {0} for w in (text or "").lower().split()]
    kinds, out = [], []
    for k in (0, 1):
        with_it = sum(y[k] for _, y in known)
        ratio = max(1, with_it) / max(1, len(known) - with_it)
        counts = {0: {}, 1: {}}
        for text, y in known:
            for f in set().union(*features(text)):
                counts[y[k]][f] = counts[y[k]].get(f, 0) + 1

        def odds(text, out_of=None, counts=counts, ratio=ratio):
            for fs in features(text):
                one = {f: counts[1].get(f, 0) - (out_of == 1) for f in fs}
                none = {f: counts[0].get(f, 0) - (out_of == 0) for f in fs}
                missing = math.log(quality.PSEUDO / quality.PSEUDO)
                found = [math.log((max(one[f], 0) + quality.PSEUDO) / (max(none[f], 0) * ratio + quality.PSEUDO)) for f in fs]
                yield max(found + [missing] * (len(fs) < 6))

        kinds.append((odds, ratio))
    for k, (odds, _) in enumerate(kinds):
        def facts(text, out_of=None, odds=odds):
            words, own = (text or "").lower().split(), list(odds(text, out_of))
            n, raw = max(1, len(words)), text or ""
            share = lambda test: sum(map(test, raw)) / max(1, len(raw))
            again = sum(a == b for a, b in zip(words, words[1:], strict=False))
            row = [math.log1p(n) / 5, share(lambda c: c in "#$%&*|!<>=_") * 5, share(str.isupper), share(lambda c: c in "0123456789") * 5, again / n, len(set(words)) / n, sum(own) / n]
            for level in quality.LEVELS:
                hits = sum(x >= level for x in own)
                row += [math.log1p(hits), hits / n * 10, math.log1p(hits / n * 100)]
            return row

        x, y = np.array([facts(t, y[k]) for t, y in known]), np.array([y[k] for _, y in known], float)
        mean, spread = x.mean(0), x.std(0) + 1e-3
        x, head = np.c_[(x - mean) / spread, np.ones(len(x))], np.zeros(x.shape[1] + 1)
        for _ in range(quality.NEWTON):
            p = 1 / (1 + np.exp(-np.clip(x @ head, -30, 30)))
            head -= np.linalg.solve((x.T * (p * (1 - p))) @ x + quality.RIDGE * np.eye(len(head)), x.T @ (p - y) + quality.RIDGE * head)
        logits = np.array([((np.array(facts(t)) - mean) / spread) @ head[:-1] + head[-1] for t in asked])
        out.append(1 / (1 + np.exp(np.clip(logits, -30, 30))))
    return out[0] * out[1]


def test_evidence_against_plain_loops(spark, docs):
    """The model itself, from word counts to the regression, over every document of a small table."""
    rng = random.Random(4)
    words = {"good": "river stone field house bread".split(), "poor": "click WIN $$$ free! free!".split(), "toxic": "hate, hateful awful vile".split()}
    rows, known = [], []
    for i in range(60):
        kind = rng.choice(["good", "good", "poor", "toxic"])
        rows.append((i, " ".join(rng.choice(words[kind] + words["good"]) for _ in range(rng.randint(3, 40)))))
        if i % 3:
            known.append((i, int(kind != "poor"), int(kind == "toxic")))
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.evidence for r in quality.classify(docs(rows), labels).collect()}
    texts = dict(rows)
    want = plain_evidence([(texts[i], (int(q <= 0), t)) for i, q, t in known], [t for _, t in rows])
    assert [got[i] for i, _ in rows] == pytest.approx(want.tolist(), abs=2e-3)


def test_surface_and_words():
    import pyarrow as pa

    words, tokens, bounds, surface = quality.encoded(pa.array([None, "a a b", "###"]))
    assert bounds.tolist()[0] == 0 and surface.shape[0] == 3 and np.isfinite(surface).all() and len(quality.word_slots(words[-1])) == 6 and len(tokens) == bounds[-1]
