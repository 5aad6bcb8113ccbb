"""Operator 2: benchmark decontamination by SimHash over item-sized windows.

A document is contaminated by an item if one of its windows, as many words as the item, has a weighted
Jaccard similarity of 0.8 or more with it over 5-word shingles (counts are the weights; an item of fewer
words is one shingle).

Windows get a 64-bit SimHash of their weighted shingles from running sums of bit votes, so each window
costs the same whatever its size. The items' fingerprints are indexed in eight blocks of eight bits; each
block lists all values within two bits. A fingerprint within 23 bits differs by two or less in some
block, so every one within the radius is found, and only those. Candidates are verified exactly.

A window of similarity above 0 shares a shingle with its item. So only windows over a shingle of some
item are fingerprinted; nothing that could be found is lost by it. Windows are taken in pieces of `STARTS`
starts, and all windows of a piece are verified against an item at once, by counting for each shingle the
starts at which it adds to the overlap, so repetitive texts cost no more than others.

Items are taken in blocks of a bounded size, `BLOCKS_PER_PASS` of them sent to the tasks at once; there is
no join and no shuffle of texts. A benchmark of more blocks is read against the documents once by a filter
of `FILTER_BITS` bits over its shingles, and then, pass by pass, only against documents the filter lets by.

Defined cases: null, empty and wordless texts and items match nothing; documents shorter than an item
have one window, the whole text; repeated rows and items are reported each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import text as tx
from gneiss.llm.common import id_and_text, materialize

K = 5
SIMILARITY = 80  # per cent
RADIUS = 23
BLOCKS = 8
ITEMS_PER_BLOCK = 4096
BLOCK_BYTES = 4 << 20
BLOCKS_PER_PASS = 4
FILTER_BITS = 1 << 28
STARTS = 1 << 14
U64 = np.uint64
HITS = "doc_id long, item_id long, first_word long, n_words long, similarity double"
_BITS = np.arange(64, dtype=np.uint64)
_NEAR = np.array([0, *(1 << i for i in range(8)), *((1 << i) | (1 << j) for i, j in combinations(range(8), 2))], np.uint8)


def bit_votes(h: np.ndarray) -> np.ndarray:
    """Running sums of the bits' votes, one row more than hashes."""
    votes = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(((h[:, None] >> _BITS) & U64(1)).astype(np.int32) * 2 - 1, axis=0, out=votes[1:])
    return votes


def fingerprints(votes: np.ndarray) -> np.ndarray:
    """64-bit SimHashes from rows of 64 vote sums."""
    return ((votes > 0).astype(U64) << _BITS).sum(axis=1, dtype=U64)


class Items:
    """Fingerprint index and shingles of a block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str]):
        col = pa.array([t or "" for t in texts], pa.string())
        w = tx.split_words(*tx.buffers(col))
        self.ids, self.words, self.grams = [], [], []
        for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            if b > a:
                self.ids.append(ids[i])
                self.words.append(b - a)
                self.grams.append(np.sort(tx.grams(w.hashes[a:b], min(K, b - a))))
        self.words = np.array(self.words, np.int64)
        self.k = np.minimum(self.words, K)
        prints = np.array([fingerprints(bit_votes(g)[-1:])[0] for g in self.grams], U64)
        self.prints = prints
        self.index: dict[tuple[int, int, int], list[np.ndarray]] = {}
        for m in np.unique(self.words).tolist():
            mine = np.flatnonzero(self.words == m)
            for block in range(BLOCKS):
                value = ((prints[mine] >> U64(8 * block)) & U64(255)).astype(np.uint8)
                near = (value[:, None] ^ _NEAR).ravel()
                order = np.argsort(near, kind="stable")
                cuts = np.searchsorted(near[order], np.arange(257))
                self.index[m, block, 0] = [np.repeat(mine, len(_NEAR))[order], cuts]
        #: for each shingle size: sorted hashes, where each one's sizes begin, and the sizes of the items that have it
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.mask: dict[int, np.ndarray] = {}
        for k in np.unique(self.k).tolist():
            of = np.flatnonzero(self.k == k)
            h = np.concatenate([self.grams[i] for i in of])
            m = np.repeat(self.words[of], [len(self.grams[i]) for i in of])
            order = np.lexsort((m, h))
            h, m = h[order], m[order]
            new = np.append(True, (h[1:] != h[:-1]) | (m[1:] != m[:-1]))
            h, m = h[new], m[new]
            u, at = np.unique(h, return_index=True)
            self.sizes[k] = u, np.append(at, len(h)), m
            mask = np.zeros(1 << 20, bool)
            mask[(u >> U64(44)).astype(np.int64)] = True
            self.mask[k] = mask

    def near(self, prints: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(print, item) pairs within the radius, for items of m words."""
        a, b = [], []
        for block in range(BLOCKS):
            items, cuts = self.index[m, block, 0]
            value = ((prints >> U64(8 * block)) & U64(255)).astype(np.int64)
            n = cuts[value + 1] - cuts[value]
            a.append(np.repeat(np.arange(len(prints)), n))
            edge = np.concatenate([[0], np.cumsum(n)])
            b.append(items[np.repeat(cuts[value] - edge[:-1], n) + np.arange(edge[-1])])
        pair = np.unique(np.concatenate(a) * len(self.ids) + np.concatenate(b))
        i, j = np.divmod(pair, len(self.ids))
        ok = np.bitwise_count(prints[i] ^ self.prints[j]) <= RADIUS
        return i[ok], j[ok]


def overlaps(g: np.ndarray, n: int, item: np.ndarray) -> np.ndarray:
    """Sum of the lesser counts of the item's shingles and those of each window of n shingles of g. item is sorted."""
    u, count = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(u, g), len(u) - 1)
    p = np.flatnonzero(u[at] == g)
    order = np.argsort(at[p], kind="stable")
    p, which = p[order], at[p][order]
    # a shingle met at p counts in the windows that hold it, but fewer than count[which] of its kind before it
    back = np.arange(len(p)) - count[which]
    same = (back >= 0) & (which[np.maximum(back, 0)] == which)
    low = np.maximum(p - n + 1, np.where(same, p[np.maximum(back, 0)] + 1, 0))
    windows = len(g) - n + 1
    ok = low < windows
    step = np.bincount(low[ok], minlength=windows + 1)[: windows + 1] - np.bincount(np.minimum(p[ok] + 1, windows), minlength=windows + 1)
    return np.cumsum(step)[:windows]


def scan_document(h: np.ndarray, hits: dict[int, np.ndarray], grams: dict[int, np.ndarray], items: Items) -> list[tuple[int, int, int, float]]:
    """Best window of each item found in one document: (item, first word, words, similarity)."""
    best: dict[int, tuple[float, int, int]] = {}
    for k, at in hits.items():
        u, edge, flat = items.sizes[k]
        found = np.searchsorted(u, grams[k][at])
        n = edge[found + 1] - edge[found]
        place = np.repeat(at, n)
        size = flat[np.repeat(edge[found] - np.cumsum(n) + n, n) + np.arange(len(place))]
        for m in np.unique(size).tolist():
            p = place[size == m]
            width = min(m, len(h))
            n = width - k + 1  # shingles of a window
            low, high = np.maximum(p - n + 1, 0), np.minimum(p, len(h) - width)
            new = np.append(True, low[1:] > high[:-1] + 1)
            for s, e in zip(low[new].tolist(), high[np.append(new[1:], True)].tolist(), strict=True):
                for a in range(s, e + 1, STARTS):
                    g = grams[k][a : min(a + STARTS, e + 1) + n - 1]
                    votes = bit_votes(g)
                    i, j = items.near(fingerprints(votes[n:] - votes[:-n]), m)
                    for item in np.unique(j).tolist():
                        start = i[j == item]
                        less = overlaps(g[start[0] : start[-1] + n], n, items.grams[item])[start - start[0]]
                        more = n + len(items.grams[item]) - less
                        top = int(np.argmax(less / more))
                        if 100 * less[top] >= SIMILARITY * more[top] and less[top] / more[top] > best.get(item, (0.0,))[0]:
                            best[item] = (less[top] / more[top], a + int(start[top]), width)
    return [(j, a, width, float(s)) for j, (s, a, width) in sorted(best.items())]


def _scan(blocks: list[Items]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, o in tx.chunks(batches):
            w = tx.split_words(buf, o)
            if not len(w.hashes):
                continue
            out = []
            ids = part.column(0).to_pylist()
            all_grams = {k: tx.grams(w.hashes, k) for k in {k for items in blocks for k in items.sizes}}
            for items in blocks:
                where = {}
                for k in items.sizes:
                    g = all_grams[k]
                    at = np.flatnonzero(items.mask[k][(g >> U64(44)).astype(np.int64)])
                    u = items.sizes[k][0]
                    at = at[u[np.minimum(np.searchsorted(u, g[at]), len(u) - 1)] == g[at]]
                    doc = np.searchsorted(w.first, at, "right") - 1
                    inside = at + k <= w.first[doc + 1]
                    where[k] = at[inside], doc[inside]
                for d in np.unique(np.concatenate([x[1] for x in where.values()])).tolist():
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    hits = {k: at[doc == d] - a for k, (at, doc) in where.items() if (doc == d).any()}
                    for j, first, width, s in scan_document(w.hashes[a:b], hits, {k: all_grams[k][a : b - k + 1] for k in hits}, items):
                        out.append((ids[d], items.ids[j], first, width, s))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

    return run


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Items in blocks of a bounded number and size."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"] or "")
        if len(ids) == ITEMS_PER_BLOCK or size >= BLOCK_BYTES:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def passes(benchmark: DataFrame) -> Iterator[list[Items]]:
    held: list[Items] = []
    for items in item_blocks(benchmark):
        if items.ids:
            held.append(items)
        if len(held) == BLOCKS_PER_PASS:
            yield held
            held = []
    if held:
        yield held


def _touched(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that share a shingle with some item, and a few more."""
    bits = np.zeros(FILTER_BITS >> 3, np.uint8)
    sizes: set[int] = set()
    for items in item_blocks(benchmark):
        for k, (u, _, _) in items.sizes.items():
            sizes.add(k)
            at = u >> U64(64 - (FILTER_BITS.bit_length() - 1))
            np.bitwise_or.at(bits, (at >> U64(3)).astype(np.int64), np.uint8(1) << (at & U64(7)).astype(np.uint8))
    shared = rows.sparkSession.sparkContext.broadcast(bits)  # FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, o in tx.chunks(batches):
            w = tx.split_words(buf, o)
            keep = np.zeros(part.num_rows, bool)
            for k in sizes:
                at = tx.grams(w.hashes, k) >> U64(64 - (FILTER_BITS.bit_length() - 1))
                met = np.flatnonzero((shared.value[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1)
                doc = np.searchsorted(w.first, met, "right") - 1
                keep[doc[met + k <= w.first[doc + 1]]] = True
            yield part.filter(pa.array(keep))

    return rows.mapInArrow(run, rows.schema)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that it contains: the best window and its similarity."""
    rows = id_and_text(docs)
    out: DataFrame | None = None
    touched: DataFrame | None = None
    for number, blocks in enumerate(passes(benchmark)):
        if number == 1:  # more than one pass: the others, and the first again, read what the filter leaves
            touched = materialize(_touched(rows, benchmark), "touched")
            out = touched.mapInArrow(_scan(first), HITS)
        first = blocks
        found = (rows if touched is None else touched).mapInArrow(_scan(blocks), HITS)
        out = found if out is None else out.union(found)
    return rows.sparkSession.createDataFrame([], HITS) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a passage of the benchmark, with all their columns."""
    scans = [_scan(blocks) for blocks in passes(benchmark)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scan in scans:  # each sees what those before it left
                if not batch.num_rows:
                    break
                text = batch.column(batch.schema.get_field_index("text"))
                keep = np.ones(batch.num_rows, bool)
                for hit in scan(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), text], names=["doc_id", "text"])])):
                    keep[hit.column(0).to_numpy()] = False
                batch = batch.filter(pa.array(keep))
            yield batch

    return docs.mapInArrow(run, docs.schema) if scans else docs


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return materialize(contaminated(docs, benchmark), "contaminated")
