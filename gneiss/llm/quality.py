"""Operator 3: quality classifier.

Logistic regression over hashed word n-grams, trained with follow-the-regularised-leader
(FTRL-proximal) updates and scored as sparse dot products.

Every text gives two word streams: the words as they stand and their shapes (runs of letters,
capitals and digits shrunk to one sign each, so `Then%%%` and `Athe%%%` share a shape). Unigrams and
bigrams of both, trigrams of shapes and a mark for a word that repeats the one before are hashed into
one weight table. A feature weighs its share of the text's n-grams.

Training sees at most `max_train` labelled documents, those with the smallest hashes of their ids (a
documented bound, as a classifier allows). They are dealt to `shards` tasks; each runs FTRL over its
rows and the weights are averaged, so no task or driver holds more than a shard or a table. Scoring
reads every whole text once, without a shuffle.

Defined cases: a null or empty text gets the score of the bias; a null id is scored, never learned
from and not held out; several labels for one id count as their mean (0.5 or more is good); labels
that are null are skipped; without any labels every score is 0.5. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import text as tx
from gneiss.llm.common import digest_mod, id_and_text

BITS = 18
SCALE = 12.0
THRESHOLD = 0.3
MAX_TRAIN = 20_000
SHARDS = 8

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE[128:] = 97


def shapes(w: tx.Words) -> np.ndarray:
    """Hash of each word's shape: classes of its characters, runs of one class shrunk to one sign."""
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    cls = _SHAPE[w.buf]
    keep = np.ones(len(cls), bool)
    keep[1:] = cls[1:] != cls[:-1]
    keep[w.starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return tx.hash_spans(tx._VALUES[cls[keep]], at[w.starts], at[w.ends])


def features(w: tx.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per view: hashed n-grams (table slots) in text order, and the bounds of each document's n-grams."""
    sh = shapes(w)
    again = np.zeros(len(w.hashes), bool)
    again[1:] = w.hashes[1:] == w.hashes[:-1]
    again[w.first[:-1][w.first[:-1] < len(again)]] = False
    sh = np.where(again, np.uint64(0x1234567), sh)
    for view, (h, n) in enumerate(((w.hashes, 1), (w.hashes, 2), (sh, 1), (sh, 2), (sh, 3))):
        g = tx.grams(h, n) if n > 1 else h
        slots = (tx.mix(g ^ np.uint64(view * 0x9E3779B1)) >> np.uint64(64 - BITS)).astype(np.int64)
        yield slots, np.minimum(w.first[:-1], len(slots)), np.minimum(np.maximum(w.first[1:] - n + 1, w.first[:-1]), len(slots))


def score_texts(buf: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Probability of a good text for each document; weights[-1] is the bias."""
    w = tx.split_words(buf, offsets, fold=False)
    z = np.full(len(offsets) - 1, float(weights[-1]))
    for slots, lo, hi in features(w):
        sums = np.concatenate([[0.0], np.cumsum(weights[slots], dtype=np.float64)])
        z += SCALE * (sums[hi] - sums[lo]) / np.maximum(hi - lo, 1)
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def ftrl(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02) -> np.ndarray:
    """FTRL-proximal over sparse documents (slots, values); the last slot is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def lazy(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for (i, x), y in zip(docs, labels, strict=True):
            w = lazy(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return lazy(np.arange(len(z)))


def _train_shard(table: pa.Table) -> pa.Table:
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    table = table.sort_by("turn")
    for _, buf, o in tx.chunks(iter(table.to_batches())):
        w = tx.split_words(buf, o, fold=False)
        parts = list(features(w))
        for d in range(len(o) - 1):
            slots = [s[lo[d] : hi[d]] for s, lo, hi in parts]
            values = [np.full(len(s), SCALE / max(len(s), 1)) for s in slots]
            i, inverse = np.unique(np.concatenate(slots), return_inverse=True)
            x = np.bincount(inverse, np.concatenate(values), len(i))
            docs.append((np.append(i, 1 << BITS), np.append(x, 1.0)))
    weights = ftrl(docs, table["good"].to_numpy().astype(float))
    return pa.table({"rows": pa.array([len(docs)], pa.int64()), "weights": pa.array([weights.astype(np.float32).tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, folds: int = 5, max_train: int = MAX_TRAIN, shards: int = SHARDS, label: str = "quality") -> np.ndarray:
    """Weight table learned from a bounded sample of the labelled documents outside the held-out fold.

    A labelled id has one text, the one of least hash, however many rows hold it; so max_train bounds the texts too.
    """
    ids = F.col("doc_id").cast("long").alias("doc_id")
    sample = (
        labels.select(ids, F.col(label).cast("double").alias("mark"))
        .where("doc_id is not null and mark is not null")
        .where(digest_mod("doc_id", folds) != held_out_fold)
        .groupBy("doc_id")
        .agg((F.avg("mark") >= 0.5).cast("int").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
        .withColumn("turn", F.xxhash64("doc_id", F.lit(7)))
    )
    rows = (
        id_and_text(docs)
        .join(F.broadcast(sample), "doc_id")  # at most max_train rows of ids and marks
        .groupBy("doc_id", "turn", "good")
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
        .select("turn", "good", "text", F.pmod("turn", F.lit(shards)).cast("int").alias("shard"))
        .repartition(shards, "shard")
        .groupBy("shard")
        .applyInArrow(_train_shard, "rows long, weights binary")
        .collect()
    )
    total = np.zeros((1 << BITS) + 1)
    for r in rows:
        total += r["rows"] * np.frombuffer(r["weights"], np.float32)
    return (total / max(sum(r["rows"] for r in rows), 1)).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, held_out_fold: int = 0, folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, o in tx.chunks(batches):
            s = score_texts(buf, o, weights)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(digest_mod("doc_id", folds) == held_out_fold, F.lit(False)).alias("held_out")
    return id_and_text(docs).select("doc_id", "text", held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""
    weights = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, o in tx.chunks(batches):
            yield part.filter(pa.array(score_texts(buf, o, weights) >= threshold))

    return docs.mapInArrow(run, docs.schema)
