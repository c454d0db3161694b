from collections import defaultdict

from pyspark.sql import functions as F

from gridloom.llm import line_dedup, shared

OWN = ["pos", "h1", "_h1", "_H2", "_id", "_key", "_gone", "_text", "_lines", "_line", "keeper", "_docs"]
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(UPPER)
    holds = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holds[key(line)].add(i)
    gone = {k: max(v, key=lambda i: -1 if i is None else i) for k, v in holds.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_against_brute_force(docs):
    common, odd = "A line that MANY documents hold", "É" * 20
    rows = [(i, f"own line number {i} of a text\n {common}\r\n\n{odd if i % 2 else odd.lower()}\nshort\n{common.lower()}") for i in range(9)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, common + "\n" + common), (None, common), (5, common + "\nother"), (24, "x" * 50000 + "\n" + common)]
    got = line_dedup.dedup_lines(docs(rows).withColumns({c: F.lit("mine") for c in ["n_lines", *OWN]}))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", *OWN, "n_lines", "n_dropped"]
    assert {r[5:-2] for r in got.collect()} == {("mine",) * len(OWN)}
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=str) == brute(rows)


def test_many_lines_and_empty_table(docs):
    assert line_dedup.dedup_lines(docs([])).count() == 0
    body = "\n".join(f"line {i} of one very long document" for i in range(20000))
    rows = [(1, body), (2, body), (3, body)]
    got = line_dedup.dedup_lines(docs(rows)).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(1, 20000), (2, 20000), (3, 0)]
    assert {r.text for r in got if r.doc_id < 3} == {""}


def test_tables_too_large_to_broadcast_are_shuffled(docs, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 100)
    body = "\n".join(f"line {i} of a document" for i in range(30))
    rows = [(i, body + f"\n its own line, number {i}") for i in range(5)]
    got = line_dedup.dedup_lines(docs(rows))
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=str) == brute(rows)
