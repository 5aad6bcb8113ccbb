"""Operator 4: substring dedup by sliding sentence spans.

A sentence ends at a word that ends in . ! or ?, at a line end or at the end of the text. From every
sentence two spans start, forwards and backwards: the shortest run of consecutive sentences with at
least two sentences and `min_words` words (or one sentence of twice as many). Any passage of that size
that stands elsewhere too is covered by such spans, from its first sentence to its last.

Every span is hashed over its words. A task keeps, of equal spans, only the first by (doc_id, row,
sentence), so a passage that a third of all texts share goes to its bucket once per task; the others are
known to be repeats. A bucket of the hash space finds the first span of all; every other one is a
repeat, and each sentence that a repeat covers is removed. Texts are shuffled once, to meet their
repeats.

Defined cases: null and empty texts have no sentences; white space around a removed sentence goes
with it; rows equal in id and text count as one, so neither loses to the other, and that holds for rows without
an id too, which are told apart by their text alone; an occurrence with a null id comes after all others; a null text stays null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import text as tx
from gneiss.llm.common import id_and_text, materialize, next_pow2
from gneiss.llm.jaccard import _pack, _unpack

MIN_WORDS = 20
SPANS_HELD = 1 << 21
BYTES_PER_BUCKET = 8 << 20
U64 = np.uint64
_LATE = np.int64(2**63 - 1)


@dataclass
class Sentences:
    """Sentences of a few documents and the spans that start at them; span numbers are 2 * sentence (forwards) or 2 * sentence + 1."""

    words: tx.Words
    first: np.ndarray  # first word of each sentence
    after: np.ndarray  # the word after its last
    bounds: np.ndarray  # document d has the sentences bounds[d]:bounds[d + 1]
    low: np.ndarray  # first and last sentence of each span
    high: np.ndarray
    span: np.ndarray  # its number, from the document's first sentence
    doc: np.ndarray


def find_sentences(buf: np.ndarray, offsets: np.ndarray, min_words: int) -> Sentences:
    w = tx.split_words(buf, offsets)
    n = len(w.starts)
    none = np.zeros(0, np.int64)
    if not n:
        return Sentences(w, none, none, np.zeros(len(offsets), np.int64), none, none, none, none)
    ends = np.isin(buf[w.ends - 1], np.frombuffer(b".!?", np.uint8))
    lines = np.concatenate([[0], np.cumsum(buf == 10)])
    ends[:-1] |= lines[w.starts[1:]] > lines[w.ends[:-1]]
    closing = w.first[1:] - 1
    ends[closing[w.counts > 0]] = True
    after = np.flatnonzero(ends) + 1
    first = np.concatenate([[0], after[:-1]])
    bounds = np.searchsorted(first, w.first)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    at = np.arange(len(first))
    long = after - first >= 2 * min_words
    fwd = np.maximum(np.searchsorted(after, first + min_words), at + 1)
    fwd = np.where(long, at, fwd)
    back = np.minimum(np.searchsorted(first, after - min_words, "right") - 1, at - 1)
    back = np.where(long, at, back)
    f_ok, b_ok = fwd < bounds[doc + 1], (back >= bounds[doc]) & ~long
    # a backward span that is also a forward one is left out
    b_ok[b_ok] &= fwd[np.maximum(back[b_ok], 0)] != at[b_ok]
    low, high = np.concatenate([at[f_ok], back[b_ok]]), np.concatenate([fwd[f_ok], at[b_ok]])
    number = np.concatenate([2 * at[f_ok], 2 * at[b_ok] + 1])
    owner = np.concatenate([doc[f_ok], doc[b_ok]])
    return Sentences(w, first, after, bounds, low, high, number - 2 * bounds[owner], owner)


def span_hashes(s: Sentences) -> np.ndarray:
    return tx.hash_spans(s.words.hashes, s.first[s.low], s.after[s.high]) if len(s.low) else np.zeros(0, U64)


def _send(docs: DataFrame, buckets: int, min_words: int) -> DataFrame:
    shift = U64(64 - (buckets.bit_length() - 1))

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        h, ids, rid, span = (np.concatenate([x[i] for x in held]) for i in range(4))
        order = np.lexsort((span, rid, ids, h))
        h, ids, rid, span = h[order], ids[order], rid[order], span[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else order
        again = (ids != ids[lead]) | (rid != rid[lead]) | (span != span[lead])
        blobs, where, marks = [], [], []
        cuts = np.searchsorted(h[new] >> shift, np.arange(buckets + 1, dtype=U64))
        rows, row = np.unique(rid, return_inverse=True)
        row_id = np.zeros(len(rows), np.int64)
        row_id[row] = ids
        for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if y > x:
                used, local = np.unique(row[new][x:y], return_inverse=True)
                blobs.append(_pack(h[new][x:y], local.astype(np.uint32), span[new][x:y].astype(np.uint32), rows[used], row_id[used]))
                where.append(b)
                marks.append(False)
        if again.any():
            blobs.append(_pack(rid[again], span[again].astype(np.uint32)))
            where.append(int(rid[0] % buckets))
            marks.append(True)
        for i in range(0, len(blobs), 16):
            yield pa.RecordBatch.from_arrays([pa.array(where[i : i + 16], pa.int32()), pa.array(marks[i : i + 16], pa.bool_()), pa.array(blobs[i : i + 16], pa.binary())], names=["bucket", "marks", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for part, buf, o in tx.chunks(batches):
            s = find_sentences(buf, o, min_words)
            ids = part.column(0).fill_null(int(_LATE)).to_numpy()
            held.append((span_hashes(s), ids[s.doc], part.column(2).to_numpy()[s.doc], s.span))
            size += len(s.span)
            if size >= SPANS_HELD:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return docs.select("doc_id", "text", "rid").mapInArrow(run, "bucket int, marks boolean, blob binary")


def _repeats(table: pa.Table) -> pa.Table:
    """(rid, span) of every span in a bucket but the first of equal ones, and of the marks that tasks sent along."""
    rids, spans, runs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], []
    for marks, blob in zip(table["marks"].to_pylist(), table["blob"].to_pylist(), strict=True):
        if marks:
            r, s = _unpack(blob, np.int64, np.uint32)
            rids.append(r)
            spans.append(s)
        else:
            h, row, s, r, i = _unpack(blob, U64, np.uint32, np.uint32, np.int64, np.int64)
            runs.append((h, i[row], r[row], s))
    if runs:
        h, ids, rid, span = (np.concatenate([x[i] for x in runs]) for i in range(4))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = order[twice]
        at = at[np.lexsort((span[at], rid[at], ids[at], h[at]))]
        if len(at):
            new = np.append(True, h[at][1:] != h[at][:-1])
            lead = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
            again = at[(ids[at] != ids[lead]) | (rid[at] != rid[lead]) | (span[at] != span[lead])]
            rids.append(rid[again])
            spans.append(span[again])
    return pa.table({"rid": np.concatenate(rids), "span": np.concatenate(spans).astype(np.int64)})


def repeated_sentences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_sentences, n_removed, text) for each row of docs, text without its repeats."""
    rows = id_and_text(docs).withColumn("rid", F.xxhash64("doc_id", "text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = next_pow2(size / BYTES_PER_BUCKET, 256)
    marks = _send(rows, buckets, min_words).groupBy("bucket").applyInArrow(_repeats, "rid long, span long")
    marks = materialize(marks.groupBy("rid").agg(F.collect_set("span").alias("spans")), "repeats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, o in tx.chunks(batches):
            s = find_sentences(buf, o, min_words)
            gone = np.zeros(len(s.first) + 1, np.int64)
            lists = part.column(2)
            asked = np.unique(lists.flatten().to_numpy() + 2 * np.repeat(s.bounds[:-1], np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(), 0)))
            hit = np.isin(s.span + 2 * s.bounds[s.doc], asked)
            np.add.at(gone, s.low[hit], 1)
            np.add.at(gone, s.high[hit] + 1, -1)
            gone = np.cumsum(gone)[:-1] > 0
            # a sentence's bytes run to the start of the next one in its document
            begin = s.words.starts[s.first] if len(s.first) else s.first
            raw, text = buf.tobytes(), []
            count = np.add.reduceat(np.append(gone, False), np.minimum(s.bounds[:-1], len(gone))) * (np.diff(s.bounds) > 0)
            for d, (a, b) in enumerate(zip(s.bounds[:-1].tolist(), s.bounds[1:].tolist(), strict=True)):
                x, y = int(o[d]), int(o[d + 1])
                if not count[d]:
                    text.append(raw[x:y].decode("utf-8", "replace"))
                    continue
                edges = [*begin[a:b].tolist(), y]
                text.append((raw[x : edges[0]] + b"".join(raw[edges[i] : edges[i + 1]] for i in range(b - a) if not gone[a + i])).decode("utf-8", "replace"))
            texts = pa.array(text, pa.string(), mask=part.column(1).is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(s.bounds)), pa.array(count.astype(np.int64)), texts], names=["doc_id", "n_sentences", "n_removed", "text"])

    joined = rows.join(marks, "rid", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_sentences long, n_removed long, text string")
