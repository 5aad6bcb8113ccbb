"""Operator 10: suffix-array dedup by a distributed merge sort that never compares a known prefix twice.

Every byte covered by a `length`-byte string that also starts anywhere else goes, first copies
included. Sorting the suffix at every byte isn't needed for that: a sparse suffix array does, over the
suffixes at anchors.

1. `anchors`: each `length`-byte window names the leftmost least hash among its k-byte strings as its
   anchor. Equal windows have the same anchor at the same place, so only anchors whose k-byte string
   occurs twice or more in the corpus can matter; the others go (an aggregation and a join on hashes).
2. `contexts`: for each remaining anchor, the bytes of the windows that named it, split at the anchor.
3. `sorted_runs`: each task sorts the suffixes that start at its anchors and sends them, front-coded
   (shared prefix length, rest), to ranges of the suffix order. Equal contexts of a run are sent once;
   how often a context stands in the whole corpus is counted apart, by an aggregation without bytes.
4. `merge_runs`: a range merges its runs with a loser tree whose matches start behind the known common
   prefix, which also gives the LCP array. Suffixes that agree on `length` - d bytes are neighbours in
   it; with equal d bytes before the anchor their windows at d are equal, and repeated.
5. Windows that a neighbouring range may hold too (they agree with a splitter for their whole right
   part) are compared by their hashes, packed by ranges of the hash, so a range can be cut anywhere
   and a passage that a third of all texts share spreads over many tasks.

Texts are shuffled twice at every size, to meet their anchors and their cuts; neither is broadcast, as
both grow with the corpus.

Several lengths share one suffix array: windows of the shortest length name the anchors, contexts reach as
far as the longest needs, and the merge marks the repeated windows of each length by its own cut of the LCP
array. `removal_digest` does this for 400 bytes, its contract, and for `SHORT` bytes beside it.

A text of more than `text.PIECE_BYTES` is read in pieces that overlap by the longest length less one byte,
so each of its windows lies in one piece and no task holds more than a piece's arrays.

Hashes have 64 bits. Defined cases: a null or empty text has no bytes and no span; texts under
`length` bytes are kept whole; repeated rows are copies of each other, so both lose what they share;
a null id stays null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm import text as tx
from gneiss.llm.common import discard, id_and_text, materialize, next_pow2
from gneiss.llm.jaccard import _pack, _unpack

LENGTH = 400
SHORT = 200  # bytes: about 33 words of the languages at hand, so a repeated passage of 50 words has 200 in it wherever it is cut
RANGE_BYTES = 8 << 20
MAX_RANGES = 1 << 17  # beyond a TB of contexts ranges grow instead: splitters are sent to every task
RUN_BYTES = 64 << 20
SLICE_ROWS = 500  # rows cut at once, to bound what a worker holds besides its batch
PER_RANGE = 4  # sampled contexts for each range, 4,096 at least
U64 = np.uint64
_POS_BITS = U64(28)


def gram_size(length: int) -> int:
    return max(4, length // 8)


def row_key() -> Column:
    """A row is known by its id and text, so that rows with one id stay apart; equal rows stay equal."""
    return F.xxhash64("doc_id", "text")


def find_anchors(buf: np.ndarray, offsets: np.ndarray, own: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, first window, last window, k-byte hash) of each anchor, positions in buf. own: how many windows may start in each document."""
    k = gram_size(length)
    n, w = len(buf), length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(U64)
    starts = np.arange(n - k + 1)
    h = tx.hash_spans(tx._VALUES[buf], starts, starts + k)
    key = ((h >> _POS_BITS) << _POS_BITS) | starts.astype(U64)
    pad = -len(key) % w
    blocks = np.concatenate([key, np.full(pad, ~U64(0))]).reshape(-1, w)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    m = n - length + 1
    at = (np.minimum(after[:m], before[w - 1 : w - 1 + m]) & U64((1 << int(_POS_BITS)) - 1)).astype(np.int64)
    window = np.arange(m)
    doc = np.searchsorted(offsets, window, "right") - 1
    ok = (window + length <= offsets[doc + 1]) & (window < offsets[doc] + own[doc])
    window, at, doc = window[ok], at[ok], doc[ok]
    if not len(at):
        return none, none, none, none, none.astype(U64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return doc[first], at[first], window[first], window[last], h[at[first]]


def anchors(docs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(rid, h, places) for each row and anchor string: its places, with the range of windows that named it, one packed long each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, o, own, shift in tx.pieces(batches, max(lengths) - 1):
            doc, at, first, last, h = find_anchors(buf, o, own, min(lengths))
            place = ((at - o[doc] + shift) << 32) | ((at - first) << 16) | (at - last)
            key = tx.mix(h ^ tx.mix(doc.astype(U64)))
            order = np.argsort(key, kind="stable")
            new = np.ones(len(order), bool)
            new[1:] = key[order][1:] != key[order][:-1]
            one = np.flatnonzero(new)
            rid = part.column(0).to_numpy()
            lists = pa.ListArray.from_arrays(pa.array(np.append(one, len(order)).astype(np.int32)), pa.array(place[order]))
            yield pa.RecordBatch.from_arrays([pa.array(rid[doc[order[one]]]), pa.array(h[order[one]].view(np.int64)), lists], names=["rid", "h", "places"])

    return docs.select("rid", "text").mapInArrow(run, "rid long, h long, places array<long>")


def contexts(docs: DataFrame, wanted: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(rid, at, c, lead, low, size, context) for each row and context of an anchor in wanted (rid, places), at: where its anchors are.

    The windows that named the anchor start lead to low bytes before it. A context's
    bytes stand with its first row in a task, their number with every row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, buf, o, own, shift in tx.pieces(batches, max(lengths) - 1):
            lists = part.column(2)
            inner = lists.flatten()
            doc = np.repeat(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), inner.value_lengths().to_numpy())
            place = inner.flatten().to_numpy()
            at, lead, low = (place >> 32) - shift, (place >> 16) & 0xFFFF, place & 0xFFFF
            ok = (at >= lead) & (at - lead < own[doc])
            doc, at, lead, low = doc[ok], at[ok] + o[doc[ok]], lead[ok], low[ok]
            first, end = at - lead, np.minimum(at - low + max(lengths), o[doc + 1])
            c = tx.mix(tx.hash_spans(tx._VALUES[buf], first, end) ^ tx.mix((lead + (low << 32)).astype(U64)))
            order = np.lexsort((at, c, doc))
            doc, at, first, end, lead, low, c = (x[order] for x in (doc, at, first, end, lead, low, c))
            new = np.ones(len(c), bool)
            new[1:] = (c[1:] != c[:-1]) | (doc[1:] != doc[:-1])
            one = np.flatnonzero(new)
            places = pa.ListArray.from_arrays(pa.array(np.append(one, len(c)).astype(np.int32)), pa.array(at - o[doc] + shift))
            keys = c[one].view(np.int64)
            data = []
            raw = buf.tobytes()
            for key, a, b in zip(keys.tolist(), first[one].tolist(), end[one].tolist(), strict=True):
                if key in seen:
                    data.append(None)
                else:
                    seen.add(key)
                    data.append(raw[a:b])
            rid = part.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid[doc[one]]), places, pa.array(keys), *(pa.array(x[one].astype(np.int32)) for x in (lead, low, end - first)), pa.array(data, pa.binary())],
                names=["rid", "at", "c", "lead", "low", "size", "context"],
            )

    return docs.join(wanted.hint("merge"), "rid").select("rid", "text", "places").mapInArrow(run, "rid long, at array<long>, c long, lead int, low int, size int, context binary")


# --- suffix runs ------------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of a and b, of which `at` bytes are known."""
    end = min(len(a), len(b))
    step = 16
    while at < end:
        if a[at : at + step] == b[at : at + step]:
            at = min(end, at + step)
            step = min(step * 2, 256)
        elif step == 1:
            return at
        else:
            step = max(1, step // 4)
    return at


def front_code(strings: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Shared prefix lengths with the string before, the rests, and the rests' lengths."""
    shared, rest, last = [], [], b""
    for s in strings:
        n = common_prefix(last, s)
        shared.append(n)
        rest.append(s[n:])
        last = s
    return np.array(shared, np.int32), b"".join(rest), np.array([len(x) for x in rest], np.int32)


def front_decode(shared: np.ndarray, rest: bytes, lengths: np.ndarray) -> list[bytes]:
    out, last, at = [], b"", 0
    for n, m in zip(shared.tolist(), lengths.tolist(), strict=True):
        last = last[:n] + rest[at : at + m]
        at += m
        out.append(last)
    return out


def sorted_runs(rows: DataFrame, splitters: list[tuple[bytes, bytes]]) -> DataFrame:
    """Front-coded runs for each range that a task has suffixes for. Rows without bytes add nothing to the order."""

    def flush(held: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        items = sorted(((b[lead:], b[:lead], c, low) for c, (lead, low, b) in held.items()), key=lambda x: x[:2])
        cuts = [0, *(bisect_right(items, s, key=lambda x: x[:2]) for s in splitters), len(items)]
        for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                run = items[a:b]
                shared, rest, lengths = front_code([x[0] for x in run])
                left = b"".join(x[1] for x in run)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r], pa.int32())]
                    + [pa.array([x.tobytes()], pa.binary()) for x in (shared, lengths, np.array([len(x[1]) for x in run], np.int32), np.array([x[3] for x in run], np.int32), np.array([x[2] for x in run], np.int64))]
                    + [pa.array([rest], pa.binary()), pa.array([left], pa.binary())],
                    names=["range", "shared", "lengths", "leads", "lows", "c", "rest", "left"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        size = 0
        for batch in batches:
            for c, lead, low, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if c not in held:
                    held[c] = lead, low, bytes(b)
                    size += len(b)
            if size > RUN_BYTES:
                yield from flush(held)
                held, size = {}, 0
        yield from flush(held)

    some = rows.where("context is not null").select("c", "lead", "low", "context")
    return some.mapInArrow(run, "range int, shared binary, lengths binary, leads binary, lows binary, c binary, rest binary, left binary")


class LoserTree:
    """Merges sorted runs. Each head keeps its common prefix length with the last output, so a match between two heads looks at no byte that is known."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.known = [0] * len(runs)
        self.size = next_pow2(len(runs))
        self.loser = [-1] * self.size
        self.champion = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size if node - self.size < len(self.runs) else -1
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, self.loser[node] = self._match(a, b)
        return win

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser). The loser's known prefix becomes that with the winner."""
        if b < 0 or self.at[b] >= len(self.runs[b][0]):
            return a, b
        if a < 0 or self.at[a] >= len(self.runs[a][0]):
            return b, a
        ka, kb = self.known[a], self.known[b]
        if ka != kb:  # the longer prefix shared with the last output is the smaller string
            return (a, b) if ka > kb else (b, a)
        x, y = self.runs[a][0][self.at[a]], self.runs[b][0][self.at[b]]
        n = common_prefix(x, y, ka)
        less = x[n : n + 1] <= y[n : n + 1]
        win, lose = (a, b) if less else (b, a)
        self.known[lose] = n
        return win, lose

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(run, place, common prefix with the output before) in order."""
        while self.champion >= 0 and self.at[self.champion] < len(self.runs[self.champion][0]):
            r = self.champion
            yield r, self.at[r], self.known[r]
            self.at[r] += 1
            if self.at[r] < len(self.runs[r][0]):
                self.known[r] = self.runs[r][1][self.at[r]]
            node, win = (self.size + r) // 2, r
            while node:
                win, self.loser[node] = self._match(win, self.loser[node])
                node //= 2
            self.champion = win


def _pairs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it stands twice or more, and whether this is the first of its copies."""
    by = np.argsort(key)
    same = key[by][1:] == key[by][:-1]
    twice, first = np.zeros(len(key), bool), np.ones(len(key), bool)
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    first[by[1:][same]] = False
    return twice, first


def _spans(i: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Distinct i, and the runs of consecutive d of each as from-to pairs."""
    order = np.lexsort((d, i))
    i, d = i[order], d[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (d[1:] != d[:-1] + 1)
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(i))[: len(at)] - 1
    flat = np.stack([d[at], d[ends]], axis=1).astype(np.int32).ravel()
    owner, first = np.unique(i[at], return_index=True)
    return owner, pa.ListArray.from_arrays(pa.array(np.append(2 * first, len(flat)).astype(np.int32)), pa.array(flat))


def merge_runs(splitters: list[tuple[bytes, bytes]], lengths: tuple[int, ...]):
    """The reducer of one range: repeated windows of its contexts, and hashes of those that other ranges may hold."""

    def reach_of(right: list[bytes], lead: int, r: int) -> np.ndarray:
        """Bytes that each suffix shares with an end of the range, where they are enough for a window; suffixes are in order, so those are first or last."""
        reach = np.zeros(len(right), np.int64)
        least = min(lengths) - lead
        for e, places in ((r - 1, range(len(right))), (r, range(len(right) - 1, -1, -1))):
            if 0 <= e < len(splitters):
                for i in places:
                    n = common_prefix(right[i], splitters[e][0])
                    if n < least:
                        break
                    reach[i] = max(reach[i], n)
        return reach

    def reduce(table: pa.Table) -> pa.Table:
        r = table["range"][0].as_py()
        cols = {x: table[x].to_pylist() for x in table.column_names if x != "range"}
        ints = lambda x, kind=np.int32: np.frombuffer(x, kind)
        runs = []
        for s, m, rest in zip(cols["shared"], cols["lengths"], cols["rest"], strict=True):
            runs.append((front_decode(ints(s), rest, ints(m)), ints(s).tolist()))
        order = list(LoserTree(runs))
        base = np.concatenate([[0], np.cumsum([len(x[0]) for x in runs])])
        pick = np.array([base[a] + b for a, b, _ in order], np.int64)
        lcp = np.array([x for _, _, x in order], np.int32)
        lcp[0] = 0
        right = [runs[a][0][b] for a, b, _ in order]
        lead = np.concatenate([ints(x) for x in cols["leads"]])[pick]
        low = np.concatenate([ints(x) for x in cols["lows"]])[pick]
        c = np.concatenate([ints(x, np.int64) for x in cols["c"]])[pick]
        ends = np.cumsum(np.concatenate([ints(x) for x in cols["leads"]]))
        lefts = b"".join(cols["left"])
        left = np.zeros((len(pick), int(lead.max())), np.uint8)
        for i, (j, m) in enumerate(zip(pick.tolist(), lead.tolist(), strict=True)):
            if m:
                left[i, :m] = np.frombuffer(lefts, np.uint8, m, int(ends[j]) - m)[::-1]
        reach = reach_of(right, int(lead.max()), r)
        size = np.array([len(x) for x in right])
        near = np.maximum(lcp, np.append(lcp[1:], 0))  # bytes shared with a neighbour
        found: list[list[tuple[np.ndarray, int]]] = [[] for _ in lengths]
        edges: list[tuple[bytes, int, int, int]] = []
        lh = np.zeros(len(pick), U64)
        power = 1
        for d in range(int(lead.max()) + 1):
            if d:
                power = power * tx._BASE % 2**64
                lh += tx._VALUES[left[:, d - 1]] * U64(power)
            for j, length in enumerate(lengths):
                here = np.flatnonzero((low <= d) & (d <= lead) & (size >= length - d) & ((near >= length - d) | (reach >= length - d)))
                if not len(here):
                    continue
                run_id = np.cumsum(lcp < length - d)[here].astype(U64)
                twice, first = _pairs(tx.mix(lh[here] ^ tx.mix(run_id + U64(1))))
                found[j].append((here[twice], d))
                for i in here[first & (reach[here] >= length - d)].tolist():  # alone here, or the first of its copies
                    window = left[i, :d][::-1].tobytes() + right[i][: length - d]
                    edges.append((hashlib.blake2b(window, digest_size=8).digest(), i, d, j))
        out = []
        for j, x in enumerate(found):
            i, spans = _spans(np.concatenate([np.zeros(0, np.int64), *(a for a, _ in x)]), np.concatenate([np.zeros(0, np.int64), *(np.full(len(a), d) for a, d in x)]))
            out.append(pa.table({"c": pa.array(c[i]), "j": pa.array(np.full(len(i), j, np.int32)), "spans": spans, "bucket": pa.nulls(len(i), pa.int32()), "edges": pa.nulls(len(i), pa.binary())}))
        eh = np.frombuffer(b"".join(x[0] for x in edges), U64)
        ei, ed, ej = (np.array([x[k] for x in edges], np.int64) for k in (1, 2, 3))
        part = (eh % U64(max(len(splitters), 1))).astype(np.int32)
        buckets = np.unique(part).tolist()
        blobs = [_pack(eh[part == b], c[ei[part == b]], ed[part == b].astype(np.int32), ej[part == b].astype(np.int32)) for b in buckets]
        none = len(buckets)
        out.append(pa.table({"c": pa.nulls(none, pa.int64()), "j": pa.nulls(none, pa.int32()), "spans": pa.nulls(none, pa.list_(pa.int32())), "bucket": pa.array(buckets, pa.int32()), "edges": pa.array(blobs, pa.binary())}))
        return pa.concat_tables(out)

    return reduce


def _meet(table: pa.Table) -> pa.Table:
    """Of one bucket of windows at the ranges' ends: those that two ranges hold."""
    h, c, d, j = (np.concatenate(x) for x in zip(*(_unpack(b, U64, np.int64, np.int32, np.int32) for b in table["edges"].to_pylist()), strict=True))
    at = np.flatnonzero(_pairs(h)[0])
    return pa.table({"c": pa.array(c[at], pa.int64()), "j": pa.array(j[at], pa.int32()), "spans": pa.array([[x, x] for x in d[at].tolist()], pa.list_(pa.int32()))})


def copied(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(c, j, spans) for each context that stands twice or more in all rows, wherever its bytes are: all its windows are repeated."""
    twice = rows.groupBy("c").agg(F.sum(F.size("at")).alias("n"), F.max("lead").alias("lead"), F.max("low").alias("low"), F.max("size").alias("size")).where("n > 1")
    each = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(length).alias("length")) for j, length in enumerate(lengths)))).alias("x")
    low = F.greatest(F.col("x.length") - (F.col("size") - F.col("lead")), F.col("low"))
    return twice.select("c", "size", "low", "lead", each).select("c", F.col("x.j").alias("j"), F.array(low, "lead").alias("spans")).where("spans[0] <= spans[1]")


def repeated(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(c, j, spans) for each context: from-to pairs of d, where the window of lengths[j] that starts d bytes before the anchor is repeated."""
    held = rows.where("context is not null")
    total, count = held.agg(F.coalesce(F.sum(F.length("context")), F.lit(0)), F.count("*")).first()
    ranges = min(next_pow2(total / RANGE_BYTES, 32), MAX_RANGES)
    most = max(4096, PER_RANGE * ranges)
    share = min(1.0, 4 * most / max(count, 1))
    drawn = held.where(F.pmod(F.xxhash64("c"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30))))
    picked = drawn.orderBy(F.xxhash64("c"), "c").limit(most).select("lead", "context").toLocalIterator()  # `most` contexts, each under 2 * max(lengths) bytes
    sample = sorted({(bytes(x["context"])[x["lead"] :], bytes(x["context"])[: x["lead"]]) for x in picked})
    splitters = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    found = materialize(
        sorted_runs(rows, splitters).groupBy("range").applyInArrow(merge_runs(splitters, lengths), "c long, j int, spans array<int>, bucket int, edges binary"),
        "ranges",
    )
    outer = found.where("bucket is not null").select("bucket", "edges").groupBy("bucket").applyInArrow(_meet, "c long, j int, spans array<int>")
    marked = found.where("bucket is null").select("c", "j", "spans").union(outer).union(copied(rows, lengths))
    result = materialize(marked.groupBy("c", "j").agg(F.flatten(F.collect_set("spans")).alias("spans")), "result")
    discard(found)
    return result


def merge_spans(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (group, start, end) with those of a group that touch or overlap made one, in order."""
    order = np.lexsort((start, group))
    group, start, end = group[order], start[order], end[order]
    wide = np.int64(1) << 36
    reach = np.maximum.accumulate(end + group * wide)
    new = np.ones(len(group), bool)
    new[1:] = start[1:] + group[1:] * wide > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(group))[: len(at)] - 1
    return group[at], start[at], reach[last] - group[at] * wide


def repeated_spans(docs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(rid, cuts): for each row key with repeated text, from-to byte pairs for each of the lengths. docs has rid and text."""
    found = materialize(anchors(docs, lengths), "anchors")
    twice = materialize(found.groupBy("h").agg(F.sum(F.size("places")).alias("n")).where("n > 1").select("h"), "repeated")
    wanted = found.join(twice, "h").groupBy("rid").agg(F.collect_set("places").alias("places"))
    rows = materialize(contexts(docs, wanted, lengths), "contexts")
    discard(found, twice)
    result = repeated(rows, lengths)
    at = rows.select("c", "rid", "at").join(result, "c")
    sizes = np.array(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            j, places, spans = (lists.flatten().field(i) for i in range(3))
            j, row = j.to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            pair = spans.flatten().to_numpy().reshape(-1, 2)  # each place of a context with each of its spans
            n, m = places.value_lengths().to_numpy().astype(np.int64), spans.value_lengths().to_numpy().astype(np.int64) // 2
            owner = np.repeat(np.arange(len(j)), n * m)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            at = places.flatten().to_numpy()[(np.cumsum(n) - n)[owner] + inside // m[owner]]
            ab = pair[(np.cumsum(m) - m)[owner] + inside % m[owner]]
            group, start, end = merge_spans(row[owner] * len(sizes) + j[owner], at - ab[:, 1], at - ab[:, 0] + sizes[j[owner]])
            edges = np.searchsorted(group, np.arange(len(lists) * len(sizes) + 1)) * 2
            each = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(np.stack([start, end], axis=1).ravel()))
            cuts = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * len(sizes)), each)
            yield pa.RecordBatch.from_arrays([batch.column(0), cuts], names=["rid", "cuts"])

    spans = at.groupBy("rid").agg(F.collect_set(F.struct("j", "at", "spans")).alias("x")).mapInArrow(run, "rid long, cuts array<array<long>>")
    out = materialize(spans, "cuts")
    discard(rows, result)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("rid", row_key())


def _cut(raw: bytes, cuts: list[int] | None) -> bytes:
    if not cuts:
        return raw
    edges = [0, *cuts, len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def removal_digest(docs: DataFrame, length: int = LENGTH, short: int = SHORT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs, all for `length`; n_repeated_short counts the bytes covered by repeated strings of `short` bytes."""
    rows = keyed(docs)
    spans = repeated_spans(rows, (length, short))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, count, sha, less = [], [], [], [], []
            for raw, cuts in zip(batch.column(1), batch.column(2), strict=True):
                raw = raw.as_buffer().to_pybytes()
                long, few = cuts.as_py() or ([], [])
                kept = _cut(raw, long)
                size.append(len(raw))
                removed.append(len(raw) - len(kept))
                count.append(len(long) // 2)
                sha.append(hashlib.sha256(kept).hexdigest())
                less.append(sum(few[1::2]) - sum(few[::2]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, t) for x, t in zip((size, removed, count, sha, less), kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_short"]
            )

    out = rows.join(spans.hint("merge"), "rid", "left").select("doc_id", "text", "cuts")
    return out.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated_short long")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated text cut out and n_chars counted anew; parts of a character that a cut leaves are dropped."""
    spans = repeated_spans(keyed(docs), (length,)).select(F.col("rid").alias("k"), F.col("cuts")[0].alias("cuts"))
    columns = docs.columns
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(key.alias("k"), F.struct("*").alias("row")).join(spans.hint("merge"), "k", "left").select("row", "cuts")  # the text goes to Python once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                parts = dict(zip(columns, batch.column(0).flatten(), strict=True))
                text = [x.as_py() if not c.is_valid else _cut(x.as_buffer().to_pybytes(), c.as_py()).decode("utf-8", "ignore") for x, c in zip(parts["text"], batch.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays(list((parts | {"text": pa.array(text, pa.string())}).values()), names=columns)
        tx.give_back()

    out = rows.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
