import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import bpe, chat
from gridloom.llm.queries import op10_chat_format

PARTS = st.lists(st.sampled_from(["\\", "###", "#", " ", ": ", ":", "</turn>", "<", "/turn>", "\n", "a", "é", "assistant", "<|endoftext|>"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(PARTS, PARTS), max_size=4))
def test_formatted_text_is_read_back(turns):
    assert chat.parsed("".join(chat.formatted(r, t) for r, t in turns)) == turns


@settings(max_examples=100, deadline=None)
@given(st.one_of(PARTS, st.just("assistant")), PARTS)
def test_tokens_are_read_back(role, text):
    t = chat.Template(bpe.default_path())
    ids, mask = t.turn(role, text)
    assert t.read(ids, mask) == (role, text, text if role == "assistant" else "", len(chat.formatted(role, text)))


def test_query_against_the_table(spark, sf):
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows[r.conv_id].append((r.role, r.text or ""))
    hard = "\\### Assistant: </turn> ok"
    rows[-7] = [("user", hard), ("assistant", hard)]
    got = {r.conv_id: r for r in op10_chat_format(spark, sf).collect()}
    assert got.keys() == rows.keys()
    for conv, turns in rows.items():
        r, loss = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.formatted(a, b)) for a, b in turns)


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, ids int"
    rows = [(1, None, "user", "b", 0), (1, None, "user", "a", 0), (1, 0, None, None, 0), (None, 1, "assistant", "x" * 100_000, 0), (2, 1, "assistant", "", 0), (2, 1, "assistant", "", 0)]
    df = spark.createDataFrame(rows, schema)
    got = {r.conv_id: r for r in chat.conversation_digest(df).collect()}
    assert {k: (v.n_turns, v.loss_chars) for k, v in got.items()} == {1: (3, 0), None: (1, 100_000), 2: (2, 0)}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nuser\nb\n\n\n").hexdigest()
    assert chat.conversation_digest(df.limit(0)).count() == 0
    turns = chat.format_turns(df.filter("conv_id = 2")).first()
    assert len(turns.ids) == len(turns.loss_mask) and not any(turns.loss_mask)


if __name__ == "__main__":
    pytest.main([__file__])
