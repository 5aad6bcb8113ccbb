"""Operator 1: best-fit packing after Martello-Toth dominance reduction.

Every text becomes token ids and a closing id; only longer ones are cut into pieces of `capacity`.
Pieces of one length are alike, so the packing problem is its histogram, at most `capacity` counts
however many documents there are. That histogram is planned on the driver:

* reduction: for the longest free length, if a set of at most three pieces (it and at most two
  others) provably dominates every other set with it, that set is fixed for as many copies as there
  are, and the instance shrinks;
* best fit, longest first, packs what is left, whole classes of equal sequences at a time.

The plan has at most a few classes for each length, each with a multiplicity. Pieces then get a rank
within their length (salted counts, so that a length with a third of all pieces is spread) and look up
their sequence and offset. Texts never move: only ids, lengths and checksums are shuffled.

Tokenizing goes by distinct words: ids of a text are the ids of its parts between ASCII spaces, and
an ASCII letter followed by another ASCII sign ends a part, since neither the tokenizer's
normalization nor its pattern joins anything across those places. Texts that hold the string of a
special token are encoded whole.

Defined cases: a null or empty text is one piece with the closing id alone; a null id stays null;
repeated rows are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gneiss.llm import text as tx
from gneiss.llm.common import id_and_text, materialize, next_pow2

CAPACITY = 2048
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
CACHE_PARTS = 1 << 20
CACHE_IDS = 1 << 23
ENCODE_PARTS = 2_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
TURNS = 1 << 20
_encoders: dict[str, "PartEncoder"] = {}


class PartEncoder:
    """Token ids of texts, with the ids of distinct parts kept in a table of one place for each hash; a later part may take an earlier one's place."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core already
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(CACHE_PARTS, np.uint64)
        self.begin = np.zeros(CACHE_PARTS, np.int64)
        self.size = np.zeros(CACHE_PARTS, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    @staticmethod
    def parts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, starts and ends of the parts, and each document's bounds among them."""
        starts, ends = tx.word_bounds(buf, offsets)
        if not len(starts):
            return starts.astype(np.uint64), starts, ends, np.zeros(len(offsets), np.int64)
        letter = ((buf >= 97) & (buf <= 122)) | ((buf >= 65) & (buf <= 90))
        other = (buf < 128) & ~letter & ~tx._SPACE[buf]
        cut = np.flatnonzero(letter[:-1] & other[1:]) + 1
        cut = cut[~np.isin(cut, offsets)] if len(cut) else cut
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        return tx.hash_spans(tx._VALUES[tx._FOLD[buf]], starts, ends), starts, ends, np.searchsorted(starts, offsets)

    def _learn(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode parts; where each one's ids begin, and how many they are."""
        ids = [x.ids for a in range(0, len(parts), ENCODE_PARTS) for x in self.tokenizer.encode_batch_fast(parts[a : a + ENCODE_PARTS], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        begin = self.used + np.cumsum(sizes) - sizes
        self.used += total
        return begin, sizes

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text, as one uint32 array each; a long text by pieces between spaces."""
        if len(offsets) == 2 and len(buf) > 2 * tx.PIECE_BYTES and not any(s in buf.tobytes() for s in SPECIAL):
            return [np.concatenate([self.encode(buf[a:b], np.array([0, b - a]))[0] if b - a <= 2 * tx.PIECE_BYTES else self._whole(buf[a:b]) for a, b in tx.spaced_pieces(buf)])]
        if self.used > CACHE_IDS:
            self.clear()
        h, starts, ends, first = self.parts(buf, offsets)
        uniq, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        raw = buf.tobytes()
        at = (uniq % np.uint64(CACHE_PARTS)).astype(np.int64)
        begin, size = self.begin[at], self.size[at].astype(np.int64)
        new = np.flatnonzero(self.keys[at] != uniq)
        if len(new):
            parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)]
            begin[new], size[new] = self._learn(parts)
            self.keys[at[new]], self.begin[at[new]], self.size[at[new]] = uniq[new], begin[new], size[new]
        begin, size = begin[inverse], size[inverse]
        edge = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(begin - edge[:-1], size) + np.arange(edge[-1])]
        out = [flat[edge[a] : edge[b]] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        if any(s in raw for s in SPECIAL):
            for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if any(s in raw[a:b] for s in SPECIAL):
                    out[d] = self._whole(buf[a:b])
        return out

    def _whole(self, buf: np.ndarray) -> np.ndarray:
        return np.array(self.tokenizer.encode(buf.tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)


def encoder_of(path: str) -> PartEncoder:
    """The encoder of this Python worker, which later tasks find with its parts."""
    if path not in _encoders:
        _encoders[path] = PartEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, and turn, a number that goes round, whatever the ids are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        end = np.array([closing], np.uint32)
        turn = TaskContext.get().partitionId() * 7919
        for part, buf, o in tx.chunks(batches):
            doc, piece, start, length, crc = [], [], [], [], []
            for d, ids in enumerate(encoder.encode(buf, o)):
                ids = np.concatenate([ids, end])
                for k, a in enumerate(range(0, len(ids), capacity)):
                    x = ids[a : a + capacity]
                    doc.append(d)
                    piece.append(k)
                    start.append(a)
                    length.append(len(x))
                    crc.append(zlib.crc32(x.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(((turn + np.arange(len(doc))) % TURNS).astype(np.int32))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "turn"],
            )
            turn += len(doc)

    return id_and_text(docs).mapInArrow(run, f"{PIECES}, turn int")


# --- the plan over the histogram --------------------------------------------------------------------

Class = tuple[int, list[tuple[int, int]]]  # (multiplicity, [(length, copies in one sequence)])


def dominating_set(count: np.ndarray, size: int, capacity: int) -> list[int] | None:
    """Lengths of a set with `size` that dominates every other feasible set with it, or None.

    With room = capacity - size: alone if nothing fits; with the longest that fits if that fills the
    room, if no two others fit, or if no three fit and it is as long as any pair; with a pair if no
    three fit, its first is the longest that fits, its second the longest that then fits, and at most
    one piece lies between the two (so any other pair can be exchanged for it, piece by piece).
    """
    room = capacity - size
    count[size] -= 1
    try:
        free = np.flatnonzero(count[: room + 1])
        if not len(free):
            return [size]
        top = int(free[-1])
        if top == room:
            return [size, top]
        few = np.repeat(free[:3], np.minimum(count[free[:3]], 3))[:3]
        if len(few) < 2 or few[0] + few[1] > room:
            return [size, top]
        if len(few) == 3 and few.sum() <= room:
            return None
        second = np.searchsorted(free, room - free, "right") - 1  # for each a, the longest b <= room - a
        b = np.where(second >= 0, free[np.maximum(second, 0)], 0)
        same = (b == free) & (count[free] < 2)
        b = np.where(same, np.where(second >= 1, free[np.maximum(second - 1, 0)], 0), b)
        best = int((np.where(b > 0, free + b, 0)).max())
        if top >= best:
            return [size, top]
        low = int(b[-1])
        if low and low <= top and count[low + 1 : top].sum() <= 1:
            return [size, top, low]
        return None
    finally:
        count[size] += 1


def reduce_instance(count: np.ndarray, capacity: int) -> list[Class]:
    """Fix dominating sets until none is found; count is what stays free."""
    fixed: list[Class] = []
    changed = True
    while changed:
        changed = False
        for size in range(capacity, 0, -1):
            while count[size] > 0:
                found = dominating_set(count, size, capacity)
                if found is None:
                    break
                need = {x: found.count(x) for x in found}
                # copies stay dominated as long as they last, but for the pair rule's room between
                times = int(min(count[x] // k for x, k in need.items())) if len(found) < 3 or len(need) == 3 else 1
                if len(found) == 2 and not _still(count, found, times, capacity):
                    times = 1
                if times < 1:
                    times = 1
                for x, k in need.items():
                    count[x] -= k * times
                fixed.append((times, sorted(need.items(), reverse=True)))
                changed = True
    return fixed


def _still(count: np.ndarray, found: list[int], times: int, capacity: int) -> bool:
    """Whether the pair is dominating for the last of `times` copies too."""
    later = count.copy()
    for x in found:
        later[x] -= times - 1
    return later.min() >= 0 and later[found[0]] > 0 and dominating_set(later, found[0], capacity) == found


def best_fit(count: np.ndarray, capacity: int) -> list[Class]:
    """Best fit, longest first, over classes of equal sequences."""
    open_: dict[int, list[Class]] = {}
    rooms: list[int] = []

    def put(room: int, c: Class) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append(c)

    for size in range(capacity, 0, -1):
        left = int(count[size])
        while left:
            at = int(np.searchsorted(rooms, size)) if rooms else 0
            if at < len(rooms):
                room = rooms[at]
                many, items = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
                used = min(many, left)
                if many > used:
                    put(room, (many - used, items))
                added = items[:-1] + [(size, items[-1][1] + 1)] if items[-1][0] == size else [*items, (size, 1)]
                put(room - size, (used, added))
                left -= used
            else:
                fits = capacity // size
                full, rest = divmod(left, fits)
                if full:
                    put(capacity - fits * size, (full, [(size, fits)]))
                if rest:
                    put(capacity - rest * size, (1, [(size, rest)]))
                left = 0
    return [c for cs in open_.values() for c in cs]


def plan_classes(histogram: dict[int, int], capacity: int) -> list[Class]:
    count = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        count[size] = n
    return [*reduce_instance(count, capacity), *best_fit(count, capacity)]


def lookup_table(classes: list[Class]) -> dict[str, np.ndarray]:
    """Entries sorted by (length, first rank): where the ranks of a length go."""
    rows, rank, base = [], {}, 0
    for many, items in classes:
        offset = 0
        for size, k in items:
            rows.append((size, rank.get(size, 0), many, base, offset))
            rank[size] = rank.get(size, 0) + many * k
            offset += size * k
        base += many
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "many", "base", "offset"), a.T, strict=True))


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (PIECES and turn, already written) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    t = lookup_table(plan_classes(histogram, capacity))
    salts = min(next_pow2(sum(histogram.values()) / 50_000, 64), TURNS)
    salted = rows.withColumn("salt", F.pmod("turn", F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "salts")
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")).cast("long") - 1
    ranked = salted.withColumn("inside", inside).join(base.hint("merge"), ["length", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = 1 << 44
        keys = t["length"] * shift + t["rank"]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            e = np.searchsorted(keys, length * shift + rank, "right") - 1
            turn, seq = np.divmod(rank - t["rank"][e], t["many"][e])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(t["base"][e] + seq), pa.array(t["offset"][e] + turn * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("inside") + F.col("before")).alias("rank"))
    return out.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack_pieces(materialize(pieces(docs, tokenizer_path, capacity), "pieces"), capacity)
