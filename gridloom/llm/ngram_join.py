"""N-gram Jaccard self-join by prefix tries, down to connected components.

A document's set is its distinct word n-grams, as 64-bit hashes; equal sets are one node. All n-grams stand in one
global order, the rarest first (by classes of document frequency, then by hash), and the sets of a task in one trie in
that order. Two linked sets share at least one of their first `size - least + 1` n-grams, where `least` is the smallest
overlap that any link of theirs needs: the prefix. The steps, each a fixed number of jobs:

1. Which sets can have links. An n-gram that no other set holds can't be part of an overlap, so a set needs `least`
   n-grams that others hold as well; most texts fall out here. Packs of sets send their n-grams by hash, each at most
   once a pack, so an n-gram of a third of all documents costs one entry a pack.
2. The global order. Frequencies are counted among the sets that are left, and come back as one byte an n-gram.
3. Keys. Nodes with a common prefix n-gram are tied to the smallest of them, linear in the nodes of a key; sets whose
   keys hang together form a block, so that a set travels once and not once a key.
4. Tries. A trie posts, for each n-gram, the sets below it that have it among their early n-grams. A probe walks the
   branches with enough of its own early n-grams, sums the overlap of a common prefix once, and leaves a subtree when
   the n-grams that remain on either side can't reach the threshold. The postings only say which branches to enter;
   links are decided by the walk. Sets that are already connected with the probe are left out.
5. Blocks over `TASK_GRAMS` n-grams or `TASK_SETS` sets are dealt over tasks by salt, with a few pivots in each. What
   these tries have not connected meets by key: only keys whose sets lie in several components are open. Keys with
   few sets meet in bins of keys; for those with many, the sets outside of the largest component meet all the others,
   in pairs of chunks. So all pairs with a common key have met in a trie or are connected.

Defined cases: a text with fewer words than n is one n-gram; one without words is empty, linked with nothing, and is
its own component; documents that share a doc_id are compared by their own texts; a null doc_id counts only if its
component has no other id; extra columns pass through `keep_one`; an empty table gives no rows. Equality of n-grams is
that of 64-bit hashes (58 bits and the class of frequency within a trie), and equality of sets that of 128-bit ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import checked_broadcast, fresh, packs, removed, text_key, tidy, trimmed, whole_texts, written

#: Entries of a bucket of the shuffles by n-gram.
BUCKET_GRAMS = 1_000_000
#: N-grams and sets of a block that one task holds; sets of a larger block that all its tasks hold, about.
TASK_GRAMS, TASK_SETS, PIVOTS = 1_500_000, 2_048, 16
#: Depths at which the levels of a trie begin.
EDGES = np.array([0, *(8 << i for i in range(50))], np.int64)
U = np.uint64
#: What packs send: for each n-gram 40 bits of its hash and the only set of the pack that holds it, or MANY.
ENTRY, MANY = np.dtype([("tag", "<u4"), ("low", "u1"), ("owner", "<u2")]), 0xFFFF
NODE = np.dtype([("node", "<i8"), ("size", "<u4"), ("shared", "<u4")])
COUNT = np.dtype([("gram", "<u8"), ("sets", "<u2")])


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(whole_texts(texts)))
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False)
    vocabulary = pd.util.hash_array(distinct, categorize=False) if len(distinct) else np.zeros(0, U)
    blank = distinct == ""
    index = coded.indices.to_numpy(zero_copy_only=False)
    real = ~blank[index] if len(index) else np.zeros(0, bool)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    kept = np.concatenate([[0], np.cumsum(real)])[bounds]  # words of each text without the empty pieces at its ends
    hashes = vocabulary[index[real]]
    grams = hashes.copy()
    for i in range(1, n):
        grams[: len(hashes) - i] = mixed(grams[: len(hashes) - i]) + hashes[i:]
    grams = mixed(grams)
    out = []
    for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            out.append(np.array([xxhash.xxh64_intdigest(hashes[a:b].tobytes(), seed=1)], U))
        else:
            out.append(np.zeros(0, U))
    return out


def node_of(grams: np.ndarray) -> int:
    """The name of a set: the lower half of its 128-bit hash, signed."""
    low = xxhash.xxh3_128_intdigest(grams.tobytes()) & (2**64 - 1)
    return low - (low >> 63 << 64)


def run_starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def pieces(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each piece, one piece after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def table(**columns: tuple[list, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in columns.values()], names=[*columns])


class Threshold:
    """Jaccard of at least num/den, in integers; sizes may be arrays."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the threshold is a fraction over 0, and 1 at most")
        self.num, self.den = num, den

    def needed(self, a, b):
        """The least overlap of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def least(self, a):
        """The least overlap of a set of size a with any set that it is linked with; also the size of the smallest such."""
        return -(-self.num * a // self.den)


class Trie:
    """Sets in a trie, level by level. Sets are given as sorted n-grams in the global order; n-grams that no other set
    holds may be left out, and `sizes` counts them too. Inside, sets are numbered in the order of the trie.

    A node of a level is a run of n-grams that sets with the same n-grams up to its end have in common; the last node
    of each set is its own. `branch` gives the node of each set, `longest` and `smallest` the most n-grams and the
    least size of the sets below a node.
    """

    def __init__(self, t: Threshold, sets: list[np.ndarray], sizes: np.ndarray):
        self.t, lengths = t, np.array([len(s) for s in sets], np.int64)
        grams, dense = np.unique(np.concatenate(sets), return_inverse=True)
        dense, cuts = dense.astype(np.int32), np.concatenate([[0], np.cumsum(lengths)]).tolist()
        letters = dense.astype(">u4").tobytes()
        order = sorted(range(len(sets)), key=lambda i: letters[4 * cuts[i] : 4 * cuts[i + 1]])
        self.order, self.length, self.size = np.array(order), lengths[order], np.asarray(sizes, np.int64)[order]
        self.own = [dense[cuts[i] : cuts[i + 1]] for i in order]
        self.mark = np.zeros(len(grams), bool)
        self.depth = np.searchsorted(EDGES, self.length)
        common = np.zeros(len(sets), np.int64)
        for i, (a, b) in enumerate(zip(self.own[:-1], self.own[1:], strict=True), 1):
            n = min(len(a), len(b))
            unlike = a[:n] != b[:n]
            at = int(unlike.argmax())
            common[i] = at if unlike[at] else n
        same = np.minimum(np.searchsorted(EDGES[1:], common, "right"), self.depth - 1)  # levels in common with the set before
        same[1:] = np.minimum(same[1:], self.depth[:-1] - 1)
        self.levels = []
        for k in range(int(self.depth.max())):
            held = np.flatnonzero(self.depth > k)
            new = same[held] <= k
            branch = np.full(len(sets), -1, np.int64)
            branch[held] = np.cumsum(new) - 1
            runs = [self.own[i][EDGES[k] : EDGES[k + 1]] for i in held[new].tolist()]
            widths, firsts = np.array([len(r) for r in runs], np.int64), np.flatnonzero(new)
            longest, smallest = np.maximum.reduceat(self.length[held], firsts), np.minimum.reduceat(self.size[held], firsts)
            self.levels.append((branch, np.concatenate(runs), np.cumsum(widths) - widths, widths, np.array([r[-1] for r in runs]), longest, smallest))
        # Linked sets agree on one n-gram of their prefixes, and on `extra` ones of prefixes that are longer by as many.
        least = t.least(self.size)
        self.extra = np.maximum(1, self.size - least)
        self.early = np.clip(self.length - least + self.extra, 0, self.length)
        firsts = np.concatenate([own[:n] for own, n in zip(self.own, self.early.tolist(), strict=True)])
        by_gram = np.argsort(firsts, kind="stable")
        self.posted = np.repeat(np.arange(len(sets), dtype=np.int32), self.early)[by_gram]
        self.posts = np.concatenate([[0], np.cumsum(np.bincount(firsts, minlength=len(grams)))])

    def links(self, me: int, allowed: np.ndarray) -> np.ndarray:
        """The sets among `allowed` (a mask) that are linked with set `me`."""
        t, own, size = self.t, self.own[me], int(self.size[me])
        early = own[: self.early[me]]
        met = np.bincount(self.posted[pieces(self.posts[early], self.posts[early + 1] - self.posts[early])], minlength=len(self.own))
        needed = t.needed(size, self.size)
        alive = np.flatnonzero(allowed & (met > 0) & (met >= np.minimum(np.minimum(self.extra, self.extra[me]), needed)))
        least, out, shared = t.least(size), [], np.zeros(len(alive), np.int64)
        self.mark[own] = True
        for k, (branch, runs, starts, widths, last, longest, smallest) in enumerate(self.levels):
            if not len(alive):
                break
            nodes, first, back = np.unique(branch[alive], return_index=True, return_inverse=True)
            width = widths[nodes]
            so_far = shared[first] + np.add.reduceat(self.mark[runs[pieces(starts[nodes], width)]], np.cumsum(width) - width, dtype=np.int64)
            rest = np.minimum(longest[nodes] - EDGES[k] - width, len(own) - np.searchsorted(own, last[nodes], "right"))
            stays = (so_far + rest >= t.needed(size, np.maximum(smallest[nodes], least)))[back]
            shared, ends = so_far[back], self.depth[alive] == k + 1
            out.append(alive[ends & stays & (shared >= needed[alive])])
            alive, shared = alive[stays & ~ends], shared[stays & ~ends]
        self.mark[own] = False
        return np.concatenate([np.zeros(0, np.int64), *out])


def components_of(t: Threshold, sets: list[np.ndarray], sizes: np.ndarray, known: np.ndarray | None = None, probes: np.ndarray | None = None) -> np.ndarray:
    """A label for each set, equal for sets that links connect.

    known: labels that hold already. probes: a mask of the sets that meet all others; all, if none is given.
    """
    trie = Trie(t, sets, sizes)
    label = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1][trie.order]
    asked = np.arange(len(sets)) if probes is None else np.flatnonzero(probes[trie.order])
    for me in asked[np.argsort(trie.size[asked], kind="stable")].tolist():
        allowed = label != label[me]
        if probes is None:  # smaller ones have met this one
            allowed &= trie.size >= trie.size[me]
        if allowed.any():
            found = trie.links(me, allowed)
            if len(found):
                joined = np.zeros(len(sets), bool)
                joined[label[found]] = True
                label[joined[label]] = label[me]
    out = np.empty(len(sets), np.int64)
    out[trie.order] = label
    return out


def slim_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_key, n_shingles, s1, s2 (128 bits of the set's hash, s1 its node) of every document."""
    def run(batches):
        for batch in batches:
            for a, b in packs(batch.column("text")):
                part = batch.slice(a, b - a)
                sets = gram_sets(part.column("text"), n)
                whole = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                halves = [np.array([(h >> s) & (2**64 - 1) for h in whole], U).view(np.int64) for s in (0, 64)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, halves)], names=["doc_id", "text_key", "n_shingles", "s1", "s2"])

    return docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key")).mapInArrow(tidy(run), "doc_id long, text_key long, n_shingles long, s1 long, s2 long")


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of sorted keys by bucket and then by key, where each bucket begins in it, and the end)."""
    place = (keys % U(buckets)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    return order, np.searchsorted(place[order], np.arange(buckets + 1))


def linkable(docs: DataFrame, n: int, t: Threshold, buckets: int) -> DataFrame:
    """node of each set with at least `least` n-grams that other sets hold."""
    def send(batches):
        for batch in batches:
            for a, b in packs(batch.column("text")):
                sets = {node_of(s): s for s in gram_sets(batch.column("text").slice(a, b - a), n) if len(s)}
                if not sets:
                    continue
                flat = np.concatenate([*sets.values()])
                owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets.values()])
                order = np.argsort(flat, kind="stable")
                grams, owner = flat[order], owner[order]
                starts = run_starts(grams)
                times = np.diff(np.append(starts, len(grams)))
                facts = np.zeros(len(sets), NODE)
                facts["node"], facts["size"] = np.array([*sets]), [len(s) for s in sets.values()]
                facts["shared"] = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(sets))
                grams, holder = grams[starts], np.where(times > 1, MANY, owner[starts])
                sent = np.zeros(len(grams), ENTRY)
                sent["tag"], sent["low"], sent["owner"] = grams >> U(32), (grams >> U(24)) & U(0xFF), holder
                order, cuts = dealt(grams, buckets)
                pack = np.frombuffer(xxhash.xxh64_digest(facts["node"].tobytes()), "<i8")[0]
                rows = [(int(pack % buckets), True, facts.tobytes())]
                rows += [(i, False, sent[order[x:y]].tobytes()) for i, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if y > x]
                yield table(bucket=([r[0] for r in rows], pa.int32()), pack=([pack] * len(rows), pa.int64()), facts=([r[1] for r in rows], pa.bool_()), x=([r[2] for r in rows], pa.binary()))

    def meet(rows: pa.Table) -> pa.Table:
        """For each pack, the sets whose n-grams of this bucket turn up elsewhere, one entry an n-gram; facts pass."""
        told = rows.filter(rows.column("facts")).select(["pack", "facts", "x"])
        rows = rows.filter(pc.invert(rows.column("facts")))
        if not rows.num_rows:
            return told
        sent = [np.frombuffer(x.as_buffer(), ENTRY) for x in rows.column("x")]
        flat = np.concatenate(sent)
        tag = flat["tag"].astype(U) << U(8) | flat["low"].astype(U)
        order = np.argsort(tag, kind="stable")
        starts = run_starts(tag[order])
        times = np.diff(np.append(starts, len(tag)))
        elsewhere = np.empty(len(tag), bool)
        elsewhere[order] = np.repeat((times > 1) | np.logical_or.reduceat(flat["owner"][order] == MANY, starts), times)
        owner, ends = flat["owner"], np.cumsum([len(s) for s in sent]).tolist()
        elsewhere &= owner != MANY
        out = [owner[a:b][elsewhere[a:b]].tobytes() for a, b in zip([0, *ends], ends, strict=False)]
        mine = pa.table({"pack": rows.column("pack"), "facts": pa.array([False] * len(out)), "x": pa.array(out, pa.binary())})
        return pa.concat_tables([told, mine])

    def judge(rows: pa.Table) -> pa.Table:
        own = rows.column("facts").to_pylist()
        facts = np.frombuffer(next(x.as_py() for x, f in zip(rows.column("x"), own, strict=True) if f), NODE)
        owners = np.concatenate([np.zeros(0, "<u2"), *(np.frombuffer(x.as_buffer(), "<u2") for x, f in zip(rows.column("x"), own, strict=True) if not f)])
        shared = facts["shared"] + np.bincount(owners, minlength=len(facts))
        return pa.table({"node": facts["node"][shared >= t.least(facts["size"].astype(np.int64))]})

    sent = docs.select("text").mapInArrow(tidy(send), "bucket int, pack long, facts boolean, x binary")
    return sent.groupBy("bucket").applyInArrow(meet, "pack long, facts boolean, x binary").groupBy("pack").applyInArrow(judge, "node long").distinct()


def packed_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """pack, nodes, sizes, grams (8-byte integers, set after set) of the sets in `wanted` (_id, _key, node).

    A set comes once a pack; it can come in several packs where rows repeat.
    """
    def run(batches):
        for batch in batches:
            for a, b in packs(batch.column("text")):
                part = batch.slice(a, b - a)
                sets = {node: s for node, s in zip(part.column("node").to_pylist(), gram_sets(part.column("text"), n), strict=True)}
                nodes = np.array([*sets], np.int64)
                sizes = np.array([len(s) for s in sets.values()], np.int64)
                yield table(pack=([np.frombuffer(xxhash.xxh64_digest(nodes.tobytes()), "<i8")[0]], pa.int64()), nodes=([nodes.tobytes()], pa.binary()), sizes=([sizes.tobytes()], pa.binary()), grams=([np.concatenate([*sets.values()]).tobytes()], pa.binary()))

    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    rows = rows.join(checked_broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    return rows.select("text", "node").mapInArrow(tidy(run), "pack long, nodes binary, sizes binary, grams binary")


def frequency_class(sets: np.ndarray) -> np.ndarray:
    """0 for n-grams of one set, then a class of its own for each frequency to 32, then one for each doubling; 63 at most."""
    steps = np.ceil(np.log2(np.maximum(sets, 33) / 32)).astype(np.int64)
    return np.where(sets <= 32, sets - 1, np.minimum(63, 31 + steps)).astype(np.uint8)


def ordered_sets(packed: DataFrame, t: Threshold, buckets: int) -> DataFrame:
    """node, size, prefix, grams: each set's shared n-grams in the global order, the first `prefix` of them its prefix."""
    def distinct(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all n-grams as places among the distinct ones, distinct ones, times, their order by bucket, its cuts)."""
        grams, back, times = np.unique(np.frombuffer(row["grams"], U), return_inverse=True, return_counts=True)
        return (back, grams, times, *dealt(grams, buckets))

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, grams, times, order, cuts = distinct(row)
                sent = np.zeros(len(grams), COUNT)
                sent["gram"], sent["sets"] = grams[order], np.minimum(times[order], 0xFFFF)
                at = [(i, sent[x:y].tobytes()) for i, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if y > x]
                yield table(bucket=([i for i, _ in at], pa.int32()), pack=([row["pack"]] * len(at), pa.int64()), x=([x for _, x in at], pa.binary()))

    def count(rows: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x.as_buffer(), COUNT) for x in rows.column("x")]
        flat = np.concatenate(sent)
        order = np.argsort(flat["gram"], kind="stable")
        starts = run_starts(flat["gram"][order])
        sets = np.add.reduceat(flat["sets"][order].astype(np.int64), starts)
        classes = np.empty(len(flat), np.uint8)
        classes[order] = np.repeat(frequency_class(sets), np.diff(np.append(starts, len(flat))))
        ends = np.cumsum([len(s) for s in sent]).tolist()
        return pa.table({"pack": rows.column("pack"), "bucket": rows.column("bucket"), "x": pa.array([classes[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)], pa.binary())})

    def order(sets: pa.Table, classes: pa.Table) -> pa.Table:
        row = sets.slice(0, 1).to_pylist()[0]  # packs of one name are equal
        back, grams, _, by_bucket, _ = distinct(row)
        parts = dict(zip(classes.column("bucket").to_pylist(), classes.column("x").to_pylist(), strict=True))
        known = np.empty(len(grams), np.uint8)
        known[by_bucket] = np.frombuffer(b"".join(parts[i] for i in sorted(parts)), np.uint8)
        rank = np.where(known > 0, known.astype(U) << U(58) | grams >> U(6), U(0))[back]
        out = []
        nodes, sizes = np.frombuffer(row["nodes"], np.int64).tolist(), np.frombuffer(row["sizes"], np.int64)
        for node, part in zip(nodes, np.split(rank, np.cumsum(sizes)[:-1]), strict=True):
            own, least = np.sort(part[part > 0]), int(t.least(len(part)))
            if len(own) >= least:
                out.append((node, len(part), len(own) - least + 1, own.tobytes()))
        return pa.table({k: pa.array([r[i] for r in out], kind) for i, (k, kind) in enumerate((("node", pa.int64()), ("size", pa.int64()), ("prefix", pa.int64()), ("grams", pa.binary())))})

    classes = packed.mapInArrow(tidy(send), "bucket int, pack long, x binary").groupBy("bucket").applyInArrow(count, "pack long, bucket int, x binary")
    return packed.groupBy("pack").cogroup(classes.groupBy("pack")).applyInArrow(order, "node long, size long, prefix long, grams binary")


def first_of_runs(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, the smallest node of each, and ties of that node with the others: a, b)."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    starts = run_starts(keys)
    heads = np.repeat(nodes[starts], np.diff(np.append(starts, len(keys))))
    apart = heads != nodes
    pairs = np.unique(np.stack([heads[apart], nodes[apart]]), axis=1)
    return keys[starts], nodes[starts], pairs[0], pairs[1]


def key_ties(ordered: DataFrame, buckets: int) -> DataFrame:
    """a, b: each node of a key tied to the smallest one, within a batch before the shuffle and across after it."""
    def send(batches):
        for batch in batches:
            sets = [np.frombuffer(g, U)[:n] for g, n in zip(batch.column("grams").to_pylist(), batch.column("prefix").to_pylist(), strict=True)]
            owners = np.repeat(batch.column("node").to_numpy(), [len(s) for s in sets])
            keys, nodes, a, b = first_of_runs(np.concatenate([np.zeros(0, U), *sets]), owners)
            order, cuts = dealt(keys, buckets)
            rows = [(-1, a.tobytes(), b.tobytes())] if len(a) else []
            rows += [(i, keys[order[x:y]].tobytes(), nodes[order[x:y]].tobytes()) for i, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if y > x]
            yield table(bucket=([r[0] for r in rows], pa.int32()), x=([r[1] for r in rows], pa.binary()), y=([r[2] for r in rows], pa.binary()))

    def meet(rows: pa.Table) -> pa.Table:
        x, y = (np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in (("x", U), ("y", np.int64)))
        if rows.column("bucket")[0].as_py() < 0:
            return pa.table({"a": x.view(np.int64), "b": y})
        _, _, a, b = first_of_runs(x, y)
        return pa.table({"a": a, "b": b})

    # Ties of a batch go on as they are, dealt by what they hold; keys meet by bucket.
    sent = ordered.select("node", "prefix", "grams").mapInArrow(tidy(send), "bucket int, x binary, y binary")
    spread = F.when(F.col("bucket") < 0, F.xxhash64("x")).otherwise(F.col("bucket").cast("long")).alias("spread")
    return sent.select("bucket", "x", "y", spread).groupBy("bucket", "spread").applyInArrow(meet, "a long, b long").distinct()


def connected(edges: DataFrame, name: str) -> DataFrame:
    """node, component (its smallest node) of every node with an edge (a, b).

    Rounds of large-star and small-star: every node ties its larger neighbours to its smallest, then its smaller ones;
    neighbours are only aggregated, never collected, and each round's table is written. Rounds grow with the logarithm
    of the longest chain of ties.
    """
    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = e.union(e.select("b", "a")) if larger else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("_low")).select(F.col("a").alias("_a"), F.least("_low", "a").alias("low"))
        met = both.join(low, F.col("a") == F.col("_a"))
        if larger:
            out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = met.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select(F.col("_a").alias("a"), F.col("low").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    now = written(edges.filter(F.col("a") != F.col("b")).select("a", "b"), name)
    total = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    state = None
    while True:
        then, now = now, written(star(star(now, True), False), name)
        removed(then)
        state, before = total(now), state
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


SETS = ["node", "size", "prefix", "grams"]


def unit_sets(rows: pa.Table) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """(the distinct sets of a task without their n-grams, and these)."""
    keys = rows.select([c for c in rows.column_names if c != "grams"]).to_pandas().drop_duplicates("node").sort_values("node")
    grams = rows.column("grams")
    return keys, [np.frombuffer(grams[i].as_buffer(), U) for i in keys.index.tolist()]


def joined_by_tries(units: DataFrame, t: Threshold) -> DataFrame:
    """split, node, component of sets by block and salt: the smallest node that links inside a task connect with each."""
    def run(rows: pa.Table) -> pa.Table:
        keys, sets = unit_sets(rows)
        nodes = keys["node"].to_numpy()
        label = components_of(t, sets, keys["size"].to_numpy())
        first = np.unique(label, return_index=True, return_inverse=True)
        if sum(map(len, sets)) > TASK_GRAMS // 8:
            trimmed()
        return pa.table({"split": keys["split"].to_numpy(), "node": nodes, "component": nodes[first[1][first[2]]]})

    return units.groupBy("block", "salt").applyInArrow(run, "split boolean, node long, component long")


def open_pairs(rows: DataFrame, t: Threshold, task_grams: int, task_sets: int) -> DataFrame:
    """a, b: components of large blocks that links of sets with a common key connect; see step 5.

    rows: block, node, size, prefix, grams, component.
    """
    def spell(batches):
        for batch in batches:
            own = [np.frombuffer(g, np.int64)[:n] for g, n in zip(batch.column("grams").to_pylist(), batch.column("prefix").to_pylist(), strict=True)]
            times = [len(x) for x in own]
            take = pa.array(np.repeat(np.arange(len(own)), times))
            weight = pa.array(np.array([len(g) // 8 for g in batch.column("grams").to_pylist()], np.int64)).take(take)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("block", "node", "component")), weight, pa.array(np.concatenate([np.zeros(0, np.int64), *own]))], names=["block", "node", "component", "weight", "key"])

    posts = rows.mapInArrow(tidy(spell), "block long, node long, component long, weight long, key long")
    keys = posts.groupBy("block", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    keys = keys.filter(F.col("lo") != F.col("hi")).select(F.col("block").alias("_b"), F.col("key").alias("_k"), ((F.col("n") > task_sets // 4) | (F.col("w") > task_grams // 4)).alias("hot"))
    hits = written(posts.join(checked_broadcast(keys), (F.col("block") == F.col("_b")) & (F.col("key") == F.col("_k"))).select("block", "node", "component", "weight", "key", "hot"), "grams-open")

    def tasks(n, w):
        return F.greatest(F.ceil(n / task_sets), F.ceil(w / task_grams), F.lit(1)).cast("long")

    # Keys with few sets: bins of keys, four times as many as their sets would fill, so that chance fills none too much.
    cold = hits.filter(~F.col("hot"))
    bins = cold.groupBy("block").agg((4 * tasks(F.count(F.lit(1)), F.sum("weight"))).alias("bins")).select(F.col("block").alias("_b"), "bins")
    cold = cold.join(checked_broadcast(bins), F.col("block") == F.col("_b")).select("block", F.lit(-1).cast("long").alias("u"), F.pmod(F.xxhash64("key"), "bins").alias("v"), "node", "component", F.lit(True).alias("probe")).distinct()
    # Keys with many: chunks of sets outside of the block's largest component, each with every chunk of all.
    many = written(hits.filter("hot").select("block", "node", "component", "weight").distinct(), "grams-many")
    sizes = many.groupBy("block", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    most = sizes.groupBy("block").agg(F.max(F.struct("w", "component")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w")).select(F.col("block").alias("_b"), F.col("top.component").alias("main"), "n", "w")
    rest = sizes.join(checked_broadcast(most.select("_b", "main")), (F.col("block") == F.col("_b")) & (F.col("component") != F.col("main")))
    rest = rest.groupBy(F.col("_b").alias("_r")).agg(tasks(F.sum("n"), F.sum("w")).alias("outer"))
    plan = most.join(rest, F.col("_b") == F.col("_r")).select("_b", "main", "outer", tasks(F.col("n"), F.col("w")).alias("all"))
    many = many.join(checked_broadcast(plan), F.col("block") == F.col("_b"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), n)
    members = many.select("block", every("outer").alias("u"), mine("all", 1).alias("v"), "node", "component", F.lit(False).alias("probe"))
    asking = many.filter(F.col("component") != F.col("main")).select("block", mine("outer", 2).alias("u"), every("all").alias("v"), "node", "component", F.lit(True).alias("probe"))
    parts = cold.union(members).union(asking).groupBy("block", "u", "v", "node", "component").agg(F.max("probe").alias("probe"))
    parts = parts.select("block", "u", "v", F.col("node").alias("_n"), "component", "probe")

    def run(unit: pa.Table) -> pa.Table:
        keys, sets = unit_sets(unit)
        known = keys["component"].to_numpy()
        label = components_of(t, sets, keys["size"].to_numpy(), known, keys["probe"].to_numpy())
        heads = pd.Series(known).groupby(label).transform("min").to_numpy()
        pairs = np.unique(np.stack([known, heads]), axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    units = parts.join(rows.select(*SETS), F.col("_n") == F.col("node")).select("block", "u", "v", "component", "probe", *SETS)
    return units.groupBy("block", "u", "v").applyInArrow(run, "a long, b long").filter(F.col("a") != F.col("b"))


def linked(ordered: DataFrame, t: Threshold, buckets: int, task_grams: int, task_sets: int) -> DataFrame:
    """node, component of every set that can have links."""
    tied = connected(key_ties(ordered, buckets), "grams-ties").select(F.col("node").alias("_n"), F.col("component").alias("block"))
    rows = ordered.join(checked_broadcast(tied), F.col("node") == F.col("_n")).select("block", *SETS)
    weight = F.octet_length("grams") / 8
    large = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w")).filter((F.col("n") > task_sets) | (F.col("w") > task_grams))
    large = written(large.select(F.col("block").alias("_b"), F.greatest(F.ceil(F.col("n") / task_sets), F.ceil(F.col("w") / task_grams)).cast("long").alias("salts"), F.ceil(F.col("n") / PIVOTS).cast("long").alias("every")), "grams-large")
    units = rows.join(checked_broadcast(large), F.col("block") == F.col("_b"), "left")
    own = F.pmod(F.xxhash64("node"), "salts")
    pivot = F.pmod(F.xxhash64("node", F.lit(3)), "every") == 0
    salts = F.when(F.col("salts").isNull(), F.array(F.lit(0).cast("long"))).when(pivot, F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).otherwise(F.array(own))
    units = units.select("block", F.col("salts").isNotNull().alias("split"), F.explode(salts).alias("salt"), *SETS)
    local = written(joined_by_tries(units, t), "grams-local")
    if not large.limit(1).count():
        return local.select("node", "component").distinct()
    edges = local.filter("split").select(F.col("node").alias("a"), F.col("component").alias("b"))
    known = connected(edges, "grams-salted").select(F.col("node").alias("_k"), "component")
    split = rows.join(checked_broadcast(large), F.col("block") == F.col("_b"), "left_semi")
    split = written(split.join(checked_broadcast(known), F.col("node") == F.col("_k"), "left").select("block", *SETS, F.coalesce("component", "node").alias("component")), "grams-split")
    more = written(open_pairs(split, t, task_grams, task_sets), "grams-pairs")
    found = connected(edges.union(more), "grams-links")
    return local.filter(~F.col("split")).select("node", "component").union(found).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, task_grams: int = TASK_GRAMS, task_sets: int = TASK_SETS) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and group (null without words) of every document.

    Documents link when the Jaccard similarity of their n-gram sets is at least num / den.
    """
    t = Threshold(num, den)
    slim = written(slim_sets(docs, n), "grams-slim")
    buckets = max(8, (slim.agg(F.sum("n_shingles")).first()[0] or 0) // BUCKET_GRAMS)
    nodes = slim.filter(F.col("n_shingles") > 0).groupBy("s1", "s2").agg(F.min("doc_id").alias("_first"), F.min(F.struct("doc_id", "text_key")).alias("_at"))
    able = linkable(docs, n, t, buckets).select(F.col("node").alias("_node"))
    wanted = written(able.join(nodes, F.col("_node") == F.col("s1")).select(F.col("_at.doc_id").alias("_id"), F.col("_at.text_key").alias("_key"), F.col("_node").alias("node")), "grams-wanted")
    packed = written(packed_sets(docs, wanted, n), "grams-packed")
    ordered = written(ordered_sets(packed, t, buckets), "grams-ordered")
    removed(packed)
    found = written(linked(ordered, t, buckets, task_grams, task_sets), "grams-found")
    removed(ordered)
    # Nodes become document ids: the smallest id of a component, over all copies of its sets.
    owned = nodes.join(found, F.col("s1") == F.col("node"), "left").withColumn("_group", F.coalesce("component", "s1"))
    smallest = owned.groupBy(F.col("_group").alias("_g")).agg(F.min("_first").alias("component_id"))
    classes = owned.join(smallest, F.col("_group") == F.col("_g")).select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), F.col("_group").alias("group"), "component_id")
    out = slim.join(classes, (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")), "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", own.alias("component_id"), "group")


def keep_one(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """`docs` with one row of each component: the one with the smallest doc_id (null last), then the smallest text key.

    Documents without words are all kept. The columns of `docs` are kept as they are.
    """
    named = near_duplicates(docs, n, num, den)
    keys = named.groupBy("group", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "copies")
    best = keys.filter(F.col("group").isNotNull()).groupBy("group").agg(F.min(order).alias("k")).select("k.doc_id", "k.text_key", "k.copies")
    kept = best.union(keys.filter(F.col("group").isNull()).select("doc_id", "text_key", F.lit(1).cast("long")))
    id_, key, copies, text = (fresh(x, docs) for x in ("id", "key", "copies", "text"))
    kept = written(kept.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("copies").alias(copies)), "grams-kept")
    rows = docs.withColumn(text, text_key(F.col("text")))

    def chosen(side: DataFrame) -> DataFrame:
        return rows.join(checked_broadcast(side), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(text) == F.col(key)))

    # Only rows that repeat are shuffled to become one.
    once, repeated = chosen(kept.filter(F.col(copies) == 1)), chosen(kept.filter(F.col(copies) > 1)).dropDuplicates(["doc_id", text])
    return once.union(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])


COMPONENTS_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS grams
  FROM words
), named AS (
  SELECT doc_id, CAST(len(grams) AS BIGINT) AS n, grams, dense_rank() OVER (ORDER BY md5(array_to_string(grams, chr(10)))) AS k FROM sets
), nodes AS (
  SELECT k, any_value(n) AS n, any_value(grams) AS grams, min(doc_id) AS first FROM named WHERE n > 0 GROUP BY k
), posts AS (
  SELECT k, n, unnest(grams) AS g FROM nodes
), links AS (
  SELECT a.k AS a, b.k AS b FROM posts a JOIN posts b ON a.g = b.g AND a.k <> b.k
  GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached AS (
  SELECT k, k AS other FROM nodes UNION SELECT r.k, l.b FROM reached r JOIN links l ON r.other = l.a
), smallest AS (
  SELECT r.k, min(n.first) AS component_id FROM reached r JOIN nodes n ON n.k = r.other GROUP BY r.k
)
SELECT doc_id, named.n AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM named LEFT JOIN smallest ON named.n > 0 AND smallest.k = named.k
"""
