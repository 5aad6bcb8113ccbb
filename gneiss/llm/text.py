"""Vectorised word hashing over Arrow string buffers.

A word is a run of bytes other than space and \\t-\\r, which on UTF-8 is the pattern
[^\\x20\\x09-\\x0D]+. Words are hashed with a polynomial over random byte values modulo 2**64,
taken from prefix sums, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
PIECE_BYTES = 4 << 20
CHUNK_ROWS = 20_000
U64 = np.uint64
_RNG = np.random.default_rng(20240229)
_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GRAM = (_RNG.integers(1, 2**63, 16, dtype=np.uint64) * U64(2) + U64(1)).tolist()

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, kept between calls."""
    global _powers
    if len(_powers[0]) < n:
        m = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        steps = []
        for b in (_BASE, _INVERSE):
            a = np.full(m, U64(b))
            a[0] = 1
            steps.append(np.multiply.accumulate(a))
        _powers = (steps[0], steps[1])
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all their bits depend on all input bits."""
    h = h.copy()
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


@dataclass
class Words:
    """Words of a few documents: their hashes in order, their byte spans, and where each document begins."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # document d has the words first[d]:first[d + 1]
    buf: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def give_back() -> None:
    """Return freed memory to the system, since Spark's Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    o = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about `limit` text bytes, one document at least and CHUNK_ROWS at most, as (slice, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, o = buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = min(max(at + 1, int(np.searchsorted(o, o[at] + limit, "right")) - 1), at + CHUNK_ROWS)
            yield batch.slice(at, to - at), buf[o[at] : o[to]], o[at : to + 1] - o[at]
            at = to
    give_back()


def pieces(batches: Iterator[pa.RecordBatch], overlap: int, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Slices as chunks() gives them, but a text of over PIECE_BYTES comes in several, each with its one row.

    As (slice, bytes, offsets, own, shift): `own` bytes of each text belong to this slice, up to `overlap`
    more are shown behind them; shift is where a piece starts in its text.
    """
    for part, buf, o in chunks(batches, text):
        if part.num_rows > 1 or len(buf) <= PIECE_BYTES + overlap:
            yield part, buf, o, np.diff(o), 0
            continue
        for a in range(0, len(buf), PIECE_BYTES):
            piece = buf[a : a + PIECE_BYTES + overlap]
            yield part, piece, np.array([0, len(piece)]), np.array([min(PIECE_BYTES, len(buf) - a)]), a


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for each span; values are uint64, one for each byte."""
    p, inv = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * p[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(U64))


def spaced_pieces(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about PIECE_BYTES that end before white space; longer only where a word is."""
    a, n = 0, len(buf)
    while a < n:
        b = a + PIECE_BYTES
        while b < n and not _SPACE[buf[b : b + PIECE_BYTES]].any():
            b += PIECE_BYTES
        b = n if b >= n else b + int(np.argmax(_SPACE[buf[b : b + PIECE_BYTES]]))
        yield a, b
        a = b


def split_words(buf: np.ndarray, offsets: np.ndarray, fold: bool = True) -> Words:
    n = len(buf)
    if n > 2 * PIECE_BYTES and len(offsets) == 2:  # one long text, to bound the arrays
        parts = []
        for a, b in spaced_pieces(buf):
            w = _words(buf[a:b], np.array([0, b - a]), fold)
            parts.append((w.hashes, w.starts + a, w.ends + a))
        hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
        return Words(hashes, starts, ends, np.array([0, len(hashes)]), buf)
    return _words(buf, offsets, fold)


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the texts start and end."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[buf]
    st, en = inside.copy(), inside.copy()
    st[1:] &= ~inside[:-1]
    en[:-1] &= ~inside[1:]
    begin, end = offsets[:-1], offsets[1:]
    begin, end = begin[begin < end], end[begin < end] - 1
    st[begin], en[end] = inside[begin], inside[end]
    return np.flatnonzero(st), np.flatnonzero(en) + 1


def _words(buf: np.ndarray, offsets: np.ndarray, fold: bool) -> Words:
    starts, ends = word_bounds(buf, offsets)
    if not len(starts):
        return Words(starts.astype(U64), starts, ends, np.zeros(len(offsets), np.int64), buf)
    values = _VALUES[_FOLD[buf]] if fold else _VALUES[buf]
    return Words(hash_spans(values, starts, ends), starts, ends, np.searchsorted(starts, offsets), buf)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive hashes."""
    if len(h) < n:
        return np.zeros(0, U64)
    m = len(h) - n + 1
    out = np.full(m, U64(n))
    for k in range(n):
        out += h[k : k + m] * U64(_GRAM[k])
    return mix(out)


def shingle_sets(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document, sorted, with the documents' bounds.

    A document of fewer words has one shingle, its whole sequence; one without words has none.
    """
    counts = w.counts
    docs = len(counts)
    all_grams = grams(w.hashes, k)
    doc_of = np.repeat(np.arange(docs), counts)
    last = w.first[1:][doc_of] if len(doc_of) else doc_of
    ok = np.flatnonzero(np.arange(len(doc_of)) + k <= last)
    hashes, owner = [all_grams[ok]], [doc_of[ok]]
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            out = np.full(len(short), U64(m))
            for j in range(m):
                out += w.hashes[w.first[short] + j] * U64(_GRAM[j])
            hashes.append(mix(out))
            owner.append(short)
    h, d = np.concatenate(hashes), np.concatenate(owner)
    if len(hashes) > 1:
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    bounds = np.searchsorted(d, np.arange(docs + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[a:b].sort()
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(docs + 1))


def set_key(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each document's sorted hash set, as signed integers."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(h) + 1, U64)
        np.cumsum(mix(h ^ U64(salt)), out=sums[1:])
        out.append(mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(U64) * U64(salt)).view(np.int64))
    return out[0], out[1]
