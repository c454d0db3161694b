"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

Two facts make BPE a left-to-right transduction. A tokenization is the right one exactly if every two neighbours stay
two tokens when their bytes are merged alone; so the last token of every prefix follows from the last tokens of
shorter prefixes. And what follows byte n can only change tokens that reach beyond a live prefix, one that ends in the
last `lookahead` bytes, where lookahead is the length of the longest token the merge list can build, less one. Tokens
that all live prefixes share are stable and leave at once; the rest is the transducer's whole memory.

Every word goes through the transducer. A text is read in slices; words that end inside a slice are remembered in a
table of bounded size, and a word that is longer than a slice is fed to the transducer as its slices come, so that
neither the word nor its tokens are ever held. Decoding maps ids to bytes and bytes to text with an incremental UTF-8
decoder.

Defined cases: null texts are empty and have no tokens; texts and words may be of any length; strings of special
tokens become their ids unless `specials` is False, and then they are ordinary text; bytes that are not UTF-8 decode
to U+FFFD; rows stand alone, so ties, repeats and empty tables need no rule; extra columns pass through, and `ids`
replaces a clashing column.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm.shared import packs, tidy

#: The pattern of words of byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The runs of characters that such words are made of.
RUNS = (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")
#: Characters that what follows a place can't reach back over: a contraction has three.
CONTEXT = 4
#: Characters of a text that are split into words at a time; words kept in a generation of the table of a worker.
SLICE, TABLE = 1 << 16, 200_000
#: The vocabulary file that is used unless a path is given.
DEFAULT_FILE = "byte_bpe_50k.json"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 for itself, others from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


NOTHING: dict = {}


class Bounded(dict):
    """A table that computes what it lacks and keeps no string longer than `longest`.

    When it is full it becomes the old generation, in place of the last one, and starts anew; what is asked for again
    comes back from there. So it holds 2 * most entries at most, and those that are used stay.
    """

    def __init__(self, compute, most: int, longest: int = 256):
        super().__init__()
        self.compute, self.most, self.longest, self.old = compute, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if isinstance(key, int) or len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Merges:
    """The merge list of a vocabulary file, by bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ids = vocab
        self.rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max(max(vocab.values()), *self.specials.values(), 0) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = token
        for content, i in self.specials.items():
            self.bytes[i] = content.encode()
        self.text = [str(i) for i in range(size)]
        self.longest = max(map(len, vocab))
        #: Bytes after a prefix that can still change its tokens.
        self.lookahead = self.longest - 1
        self.made = {a + b: (r, a, b) for (a, b), r in self.rank.items()}
        order = lambda token: self.made[token][0] if token in self.made else -1
        #: Trained lists build every token once, from tokens built before it; then ranks are the times of merges.
        self.proper = len(self.made) == len(self.rank) and all(max(order(a), order(b)) < r for r, a, b in self.made.values())
        self.ends, self.starts = (Bounded(functools.partial(self._edge, side), 1 << 14) for side in (2, 1))
        #: Whether two tokens stay two, by first id * size + second id; whether a token's bytes become this token.
        self.size = size
        self.stays = Bounded(self._stays, 1 << 17)
        self.alone = Bounded(lambda i: self.merged(self.bytes[i]) == [self.bytes[i]], 1 << 17)
        #: All tokens in a tree by byte: (id or -1, what may follow).
        self.tree: dict[int, tuple[int, dict]] = {}
        for token, i in vocab.items():
            at = self.tree
            for byte in token[:-1]:
                known, below = at.get(byte, (-1, None))
                if not below:  # leaves share one empty dict
                    at[byte] = known, (below := {})
                at = below
            if token:
                at[token[-1]] = i, at.get(token[-1], (-1, NOTHING))[1]

    def _edge(self, side: int, token: bytes) -> list[tuple[bytes, float]]:
        """The tokens at one edge of a token while it is built, each with the rank of the merge that takes it away."""
        out = [(token, float("inf"))]
        while token in self.made:
            rank = self.made[token][0]
            token = self.made[token][side]
            out.append((token, rank))
        return out

    def _stays(self, pair: int) -> bool:
        """Whether two tokens stay two when their bytes are merged alone: no merge across comes before those inside."""
        left, right = self.bytes[pair // self.size], self.bytes[pair % self.size]
        if not self.proper:
            return self.merged(left + right) == [left, right]
        for a, a_goes in self.ends[left]:
            for b, b_goes in self.starts[right]:
                rank = self.rank.get((a, b))
                if rank is not None and rank < a_goes and rank <= b_goes:
                    return False
        return True

    def merged(self, data: bytes) -> list[bytes]:
        """The definition: merge the lowest-ranked pair, the leftmost first, until none is left. For short data."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


class Transducer:
    """Tokens of one word, fed in pieces of bytes, then `finish`, which makes it ready for the next word.

    `last` holds the last token of each prefix since the last stable token, -1 where it isn't known yet; tokens that
    begin before byte `done` have been tried. Once tokens have left, `last[0]` is the last of them, else nothing.
    """

    def __init__(self, merges: Merges):
        self.m, self.room = merges, 4 * merges.longest
        self.reset()

    def reset(self) -> None:
        self.data, self.last, self.done, self.check, self.begun = bytearray(), [0], 0, self.room, False

    def feed(self, piece: bytes) -> Iterator[int]:
        for at in range(0, len(piece), self.room):
            self.data += piece[at : at + self.room]
            self._extend(len(self.data) - self.m.longest)
            if self.done >= self.check:
                yield from self._stable()

    def finish(self, piece: bytes = b"") -> list[int]:
        self.data += piece
        self._extend(len(self.data))
        out = self._back(len(self.data))
        self.reset()
        return out

    def _extend(self, to: int) -> None:
        """Tries all tokens that begin before `to`. The first that fits is the longest that ends at its place."""
        m, data, last, n = self.m, self.data, self.last, len(self.data)
        last += [-1] * (n + 1 - len(last))
        tree, stays, alone, size, begun = m.tree, m.stays, m.alone, m.size, self.begun
        for start in range(self.done, to):
            at, before, end = tree, last[start] * size, start
            for byte in data[start : start + m.longest]:
                found = at.get(byte)
                if found is None:
                    break
                token, at = found
                end += 1
                if token >= 0 and last[end] < 0 and (stays[before + token] if start or begun else alone[token]):
                    last[end] = token
        self.done = max(self.done, to)

    def _back(self, at: int) -> list[int]:
        """The tokens of a prefix."""
        out, size = [], self.m.bytes
        while at:
            out.append(self.last[at])
            at -= len(size[self.last[at]])
        return out[::-1]

    def _stable(self) -> list[int]:
        """Takes out the tokens up to the last boundary that all live prefixes share, the root of their common path."""
        live = range(max(1, self.done - self.m.lookahead), self.done + 1)
        marked, left, cut = bytearray(self.done + 1), len(live), 0
        for at in live:
            marked[at] = 1
        for at in range(self.done, 0, -1):
            if marked[at]:
                if left == 1:
                    cut = at
                    break
                before = at - len(self.m.bytes[self.last[at]])
                left += (not marked[before]) - 1
                marked[before] = 1
        out = self._back(cut)
        if cut:
            self.data, self.last, self.done, self.begun = self.data[cut:], self.last[cut:], self.done - cut, True
        self.check = max(self.room, 2 * self.done)
        return out


class Codec:
    """Encoder and decoder over one vocabulary file; `specials` says whether special strings in a text become ids."""

    def __init__(self, path: str, specials: bool = True):
        self.m = Merges(path)
        self.words, self.runs = regex.compile(WORDS), [regex.compile(r) for r in RUNS]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.m.specials, key=len, reverse=True))) + ")") if specials and self.m.specials else None
        self.table, self.transducer = Bounded(self._word, TABLE), Transducer(self.m)

    def _word(self, word: str) -> tuple[int, ...]:
        """A word's tokens."""
        t, data = self.transducer, word.encode()
        return (*t.feed(data), *t.finish()) if len(data) > self.m.longest else tuple(t.finish(data))

    def _long(self, part: str, at: int, width: int) -> Iterator[list[int] | int]:
        """The tokens of the word at a place that goes on beyond `width` characters, a list a slice; then where it ends.

        The last character of white space may belong to the next word, so it waits for what follows.
        """
        t, end = self.transducer, self.words.match(part, at, at + width).end()
        run = next(r for r in self.runs if r.match(part, end - 1, end))
        held = 1 if run is self.runs[-1] else 0
        yield list(t.feed(part[at : end - held].encode()))
        while end < len(part):
            more = run.match(part, end, end + SLICE)
            if more is None:
                break
            yield list(t.feed(part[end - held : more.end() - held].encode()))
            end = more.end()
        if held and end == len(part):
            yield list(t.feed(part[end - 1 :].encode()))
            held = 0
        yield t.finish()
        yield end - held

    def pieces(self, text: str) -> Iterator[list[int]]:
        """Token ids of a text, a list for each slice."""
        holds = self.special and any(x in text for x in self.m.specials)  # far cheaper than to split each text
        for k, part in enumerate(self.special.split(text) if holds else [text]):
            if k % 2:
                yield [self.m.specials[part]]
                continue
            at, width = 0, SLICE
            while at < len(part):
                whole = at + width >= len(part)
                words = self.words.findall(part[at : at + width])
                if not whole:
                    words.pop()  # it may go on
                    if words and words[-1][-1] == "'":  # with what follows, it may be a contraction
                        words.pop()
                    if not words:  # nothing in the slice is sure
                        if width < 4 * CONTEXT:
                            width *= 2
                            continue
                        first = self.words.match(part, at, at + width).end()
                        if first <= at + width - CONTEXT:
                            words = [part[at:first]]
                        else:
                            for out in self._long(part, at, width):
                                if isinstance(out, int):
                                    at = out
                                elif out:
                                    yield out
                            width = SLICE
                            continue
                at, width = at + (width if whole else sum(map(len, words))), SLICE
                yield list(chain.from_iterable(map(self.table.__getitem__, words)))

    def forget(self) -> None:
        """Empties the table of words at the end of a partition: workers stay, idle, beside the stages that follow."""
        self.table.clear()
        self.table.old = {}

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.pieces(text or "")))

    def decode_pieces(self, pieces: Iterable[list[int]]) -> Iterator[str]:
        utf8, table = codecs.getincrementaldecoder("utf-8")("replace"), self.m.bytes
        for ids in pieces:
            yield utf8.decode(b"".join(map(table.__getitem__, ids)))
        yield utf8.decode(b"", True)

    def decode(self, ids: list[int]) -> str:
        return "".join(self.decode_pieces([ids]))


@functools.lru_cache(maxsize=4)
def codec(path: str, specials: bool = True) -> Codec:
    """One codec per worker process, file and mode."""
    return Codec(path, specials)


def encode(df: DataFrame, path: str | None = None, specials: bool = True, text: str = "text", out: str = "ids", keep_text: bool = True) -> DataFrame:
    """`df` with an array of token ids; without the texts, if they need not come back from the Python workers."""
    path = path or default_path()
    fields = [f for f in df.schema.fields if f.name != out and (keep_text or f.name != text)]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    keep = [f.name for f in fields]

    def run(batches):
        c = codec(path, specials)
        for batch in batches:
            for start, end in packs(batch.column(text)):
                part = batch.slice(start, end - start)
                ids = pa.array([c.encode(x) for x in part.column(text).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], ids], names=[*keep, out])
        c.forget()

    return df.mapInArrow(tidy(run), schema)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the text of its token ids; null ids decode to the empty text."""
    path = path or default_path()
    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, T.StringType())])
    keep = [f.name for f in df.schema.fields if f.name != out]

    def run(batches):
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.array([c.decode(x or []) for x in part.column(ids).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], texts], names=[*keep, out])

    return df.mapInArrow(tidy(run), schema)


def round_trip_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoder and decoder in one pass, slice by slice, no ids stored."""
    path = path or default_path()

    def run(batches):
        c = codec(path)
        for batch in batches:
            rows = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in batch.column("text"):
                n, listed, decoded, utf8 = 0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
                for ids in c.pieces(text.as_py() or ""):
                    listed.update(("," * bool(n) + ",".join(map(c.m.text.__getitem__, ids))).encode())
                    decoded.update(utf8.decode(b"".join(map(c.m.bytes.__getitem__, ids))).encode())
                    n += len(ids)
                decoded.update(utf8.decode(b"", True).encode())
                rows["n_tokens"].append(n)
                rows["ids_sha256"].append(listed.hexdigest())
                rows["decoded_sha256"].append(decoded.hexdigest())
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
