"""Chat formatting by token-level assembly.

A turn is `### role: text</turn>` and a line end. The three pieces of markup are reserved ids behind the vocabulary;
role and text are encoded on their own and spliced in between, so no token crosses a border. The loss mask comes from
prefix sums of segment lengths: the tokens of assistant texts. Control strings inside roles and texts are escaped with
a backslash, as is the backslash, so that the formatted text can be read back too.

Turns of a conversation meet by a sort within partitions, and are streamed: a task holds one turn at a time, whatever
the length of a conversation.

Defined cases: null texts and roles are empty; rows of one turn go by role and then text; a null conv_id is one
conversation; a null turn comes first; an empty table gives no rows; extra columns are left out of conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bpe

#: The markup of a turn.
OPEN, SPLIT, CLOSE = "### ", ": ", "</turn>\n"
MARKUP = (OPEN, SPLIT, CLOSE)
IN_TEXT = re.compile(r"\\|###|</turn>")
IN_ROLE = re.compile(r"\\|###|</turn>|:")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)
TRAINED = "assistant"


def escape(text: str, control: re.Pattern = IN_TEXT) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


class Template:
    """Assembles and reads back turns as token ids."""

    def __init__(self, path: str):
        self.codec = bpe.codec(path, False)
        first = len(self.codec.m.bytes)
        self.open, self.split, self.close = range(first, first + len(MARKUP))

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, loss mask) of one turn."""
        segments = [[self.open], self.codec.encode(escape(role, IN_ROLE)), [self.split], self.codec.encode(escape(text)), [self.close]]
        ends = np.cumsum([len(s) for s in segments])
        steps = np.zeros(ends[-1] + 1, np.int8)
        if role == TRAINED:
            steps[ends[2]] += 1
            steps[ends[3]] -= 1
        return np.concatenate([np.asarray(s, np.int32) for s in segments]), np.cumsum(steps[:-1]).astype(bool)

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """(role, text, text under the mask, characters of the formatted turn) of one turn's tokens."""
        split = int(np.flatnonzero(ids == self.split)[0])
        role, text = self.codec.decode(ids[1:split].tolist()), self.codec.decode(ids[split + 1 : -1].tolist())
        loss = unescape(self.codec.decode(ids[mask].tolist()))
        return unescape(role), unescape(text), loss, sum(map(len, MARKUP)) + len(role) + len(text)


def formatted(role: str, text: str) -> str:
    """A turn as text."""
    return OPEN + escape(role, IN_ROLE) + SPLIT + escape(text) + CLOSE


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(role), unescape(body)) for role, body in TURN.findall(text)]


def format_turns(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, turn, role, ids, loss_mask, formatted: the tokens of every turn, row by row and without a shuffle.

    A conversation is its turns' ids in order; their places in it are running sums of `size(ids)`.
    """
    path = path or bpe.default_path()

    def run(batches):
        t = Template(path)
        for batch in batches:
            roles, texts = ([x or "" for x in batch.column(c).to_pylist()] for c in ("role", "text"))
            turns = [t.turn(r, x) for r, x in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array([i for i, _ in turns], pa.list_(pa.int32())), pa.array([m for _, m in turns], pa.list_(pa.bool_())), pa.array([formatted(r, x) for r, x in zip(roles, texts, strict=True)], pa.string())],
                names=["conv_id", "turn", "role", "ids", "loss_mask", "formatted"],
            )

    return conversations.select("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, turn long, role string, ids array<int>, loss_mask array<boolean>, formatted string")


DIGEST = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def conversation_digest(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """One row per conversation, read back from its tokens: number of turns, digests of turns and of the loss text."""
    path = path or bpe.default_path()
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def rows(batches) -> Iterator[tuple[int | None, str, str]]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)

    def conversations_of(batches):
        t, now, state = Template(path), None, None
        for conv, role, text in rows(batches):
            if state is None or conv != now:
                if state is not None:
                    yield now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role_back, text_back, loss, chars = t.read(*t.turn(role, text))
            state[0] += 1
            state[1].update(f"{role_back}\n{text_back}\n".encode())
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += chars
        if state is not None:
            yield now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    def run(batches):
        out = []
        for row in conversations_of(batches):
            out.append(row)
            if len(out) == 4096:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out, strict=True), DIGEST, strict=True)], names=[k for k, _ in DIGEST])

    return turns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: DuckDB SQL with the digests of `conversation_digest` over the table `turns` (conv_id, turn, role, text).
DIGEST_SQL = r"""
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(role) + len(regexp_extract_all(role, '\\|###|</turn>|:')) + length(text) + len(regexp_extract_all(text, '\\|###|</turn>'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
