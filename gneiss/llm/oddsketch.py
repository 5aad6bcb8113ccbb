"""Operator 13: near-duplicates by MinHash, odd sketches and banded candidates.

Documents whose sets of 2-word shingles have a Jaccard similarity of 0.8 or more are linked; the result is each
document's set size, its component, and whether it is the one that stays.

1. `describe` takes each set's MinHash of 288 samples, hashes them into 48 bands of six, and folds the samples into
   an odd sketch: a bitmap of 512 bits in which each sample flips one bit. Equal sets are one node from here on.
2. Sets that share a band meet in its bucket. Two sets of similarity 0.8 share none with a chance of
   (1 - 0.8^6)^48, under one in two million, and less above.
3. The XOR of two odd sketches holds the parity of the samples in which two sets differ, so its population count
   tells a high similarity more precisely than the samples' bits could. `most_odd_bits` works out exactly how many
   bits a pair of similarity 0.8 may show, up to one in ten million; a candidate that shows more is dropped. A second
   odd sketch, of the whole set in 768 bits, is sharper for sets of up to a thousand shingles or so, whose difference it
   counts almost exactly; the first one is as good for sets of any size. Both must pass.
4. What is left is verified on whole sets. First rounds compare the sets of a bucket with its leaders (first the set
   that meets most others in all its buckets, so the likeliest original, then random ones) and contract what is
   linked. The last round takes all candidates of a bucket that still lie in two components: those outside the
   bucket's commonest component against all, by size steps that fit, and in salts on both sides, so no task meets a
   whole bucket; sketches are compared inside the join, so that only pairs that pass leave it.

Defined cases: null, empty and wordless texts have no shingles, their own component, and stay; one word is one
shingle; equal texts are linked; a null id keeps a null component, a null `kept`, and names no other row's; repeated
ids give a row each; other columns are ignored. Hashes of 64 bits stand for shingles and for whole sets (48 bits
of a shingle where two sets are verified).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm import text as tx
from gneiss.llm.common import discard, id_and_text, materialize
from gneiss.llm.components import connected_components
from gneiss.llm.jaccard import token48, verify

K = 2  # words of a shingle
SIMILAR = 0.8
ROWS, BANDS = 6, 48
SAMPLES = ROWS * BANDS
BITS = 512
WHOLE_BITS = 768  # with more, the method that Spark generates for the last join passes the 8,000 bytes that the JVM compiles at most (70 times slower)
LOST = 1e-7  # share of pairs of similarity SIMILAR whose sketches may show more odd bits than allowed
LEADER_ROUNDS, LEADERS = 3, 4
PER_SALT = 1000
ROWS_PER_TASK = 200_000
FEW_KEYS = 200_000  # keys that are broadcast to pick the sets to verify; more are joined
DEVIATIONS = 5.5  # of the odd bits of a whole sketch over their mean, a chance under LOST
SKETCHES_AT_ONCE = 2048  # documents whose sketches are made at a time
U64 = np.uint64
_RNG = np.random.default_rng(13)
_FACTORS = _RNG.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MIXERS = _RNG.integers(0, 2**63, (SAMPLES, 2), dtype=np.uint64) * U64(2) + U64(1)


def most_odd_bits(samples: int = SAMPLES, bits: int = BITS, similar: float = SIMILAR, lost: float = LOST) -> int:
    """Odd bits of the XOR of two sketches that pairs of this similarity exceed with a chance of `lost` at most.

    Each sample differs with a chance of 1 - similar and then flips two bits at random; the number of odd bits is a
    walk, one up or down with each flip, whose distribution is followed step by step.
    """
    odd = np.zeros(bits + 2)
    odd[0] = 1.0
    at = np.arange(bits + 2)
    total = np.zeros(bits + 2)
    for differ in range(samples + 1):
        choose = lgamma(samples + 1) - lgamma(differ + 1) - lgamma(samples - differ + 1)
        total += odd * np.exp(choose + differ * log(1 - similar) + (samples - differ) * log(similar))
        for _ in range(2):
            nxt = np.zeros_like(odd)
            nxt[:-1] += (odd * at / bits)[1:]
            nxt[1:] += (odd * (1 - at / bits))[:-1]
            odd = nxt
    above = np.cumsum(total[::-1])[::-1]  # chance of that many odd bits or more
    return int(np.argmax(above <= lost)) - 1


# --- step 1 -----------------------------------------------------------------------------------------


def min_hashes(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(SAMPLES, documents): the least value of each sample over a document's shingles; no document is empty."""
    low, high = (h & U64(0xFFFFFFFF)).astype(np.uint32), (h >> U64(32)).astype(np.uint32)
    out = np.empty((SAMPLES, len(starts)), np.uint32)
    for i, factor in enumerate(_FACTORS):
        value = low * factor
        value += high
        out[i] = np.minimum.reduceat(value, starts)
    return out


def band_hashes(mins: np.ndarray) -> np.ndarray:
    """(documents, BANDS): a 64-bit hash of each band's samples, its number included."""
    mixed = mins.astype(U64) * _MIXERS[:, :1]
    return tx.mix(mixed.reshape(BANDS, ROWS, -1).sum(1, dtype=U64) + np.arange(1, BANDS + 1, dtype=U64)[:, None] * _MIXERS[0, 1]).T


def folded(place: np.ndarray, owner: np.ndarray, documents: int, bits: int) -> np.ndarray:
    """(documents, bits / 64): bit b of a document's row is the parity of its places that are b."""
    parity = np.bincount(place + owner * bits, minlength=documents * bits).astype(np.uint8) & 1
    return np.packbits(parity).view(np.int64).reshape(documents, -1)


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """Odd sketches of the MinHash samples."""
    out = [np.zeros((0, BITS // 64), np.int64)]
    for a in range(0, mins.shape[1], SKETCHES_AT_ONCE):
        some = mins[:, a : a + SKETCHES_AT_ONCE].astype(U64)
        place = (tx.mix(some + _MIXERS[:, 1:]) % U64(BITS)).astype(np.int64)
        out.append(folded(place.ravel(), np.tile(np.arange(some.shape[1]), SAMPLES), some.shape[1], BITS))
    return np.concatenate(out)


def whole_sketches(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Odd sketches of the sets h[bounds[d]:bounds[d + 1]] themselves."""
    out = [np.zeros((0, WHOLE_BITS // 64), np.int64)]
    for a in range(0, len(bounds) - 1, SKETCHES_AT_ONCE):
        o = bounds[a : a + SKETCHES_AT_ONCE + 1]
        place = (tx.mix(h[o[0] : o[-1]]) % U64(WHOLE_BITS)).astype(np.int64)
        out.append(folded(place, np.repeat(np.arange(len(o) - 1), np.diff(o)), len(o) - 1, WHOLE_BITS))
    return np.concatenate(out)


def describe(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, digest, n, key, bands, sketch, whole) for each document; the last three with the first sight of a set in a task only."""

    def lists(values: np.ndarray, new: np.ndarray) -> pa.Array:
        width = values.shape[1]
        o = np.concatenate(([0], np.cumsum(new * width))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(o), pa.array(values.ravel().view(np.int64)), mask=pa.array(~new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, buf, o in tx.chunks(batches):
            h, first = tx.shingle_sets(tx.split_words(buf, o), k)
            n, keys = np.diff(first), tx.set_key(h, first)[0]
            new = np.zeros(len(n), bool)
            for i, key in enumerate(keys.tolist()):
                if n[i] and key not in seen:
                    seen.add(key)
                    new[i] = True
            h, bounds = h[np.repeat(new, n)], np.concatenate(([0], np.cumsum(n[new])))
            mins = min_hashes(h, bounds[:-1]) if new.any() else np.zeros((SAMPLES, 0), np.uint32)
            columns = [part.column(0), part.column(2), pa.array(n), pa.array(keys, mask=n == 0), lists(np.ascontiguousarray(band_hashes(mins)), new), lists(odd_sketches(mins), new), lists(whole_sketches(h, bounds), new)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n", "key", "bands", "sketch", "whole"])

    digested = id_and_text(docs).withColumn("digest", F.xxhash64("text"))
    return digested.mapInArrow(run, "doc_id long, digest long, n long, key long, bands array<long>, sketch array<long>, whole array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, k: int = K) -> DataFrame:
    """(key, n, tokens) of the sets in wanted (digest): one text of each digest is read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, o in tx.chunks(batches):
            h, first = tx.shingle_sets(tx.split_words(buf, o), k)
            t = token48(h)
            tokens = [np.sort(t[a:b]).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(tx.set_key(h, first)[0]), pa.array(np.diff(first)), pa.array(tokens, pa.binary())], names=["key", "n", "tokens"])

    texts = id_and_text(docs).where("text is not null").groupBy(F.xxhash64("text").alias("digest")).agg(F.any_value("text").alias("text"))
    return texts.join(wanted, "digest").select("text").mapInArrow(run, "key long, n long, tokens binary")


# --- steps 2 to 4 -----------------------------------------------------------------------------------


def sizes_fit(n: str, m: str) -> Column:
    return F.expr(f"5 * least({n}, {m}) >= 4 * greatest({n}, {m})")


def odd_bits(x: str, y: str, bits: int) -> Column:
    """Population count of the XOR of two sketches."""
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(1, bits // 64)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))


def most_whole_bits(n: str, m: str) -> Column:
    """Odd bits that the whole sketches of sets of n and m shingles may differ in: they differ in (n + m) / 9 shingles
    at most, so in no more bits, and in fewer where many fall together."""
    apart = (F.col(n) + F.col(m)) / 9
    left = F.exp(-2 * apart / WHOLE_BITS)
    mean, variance = WHOLE_BITS / 2 * (1 - left), WHOLE_BITS / 4 * (1 - left * left)
    return F.least(apart, mean + DEVIATIONS * F.sqrt(variance) + 2)


def alike(most: int) -> Column:
    """Whether sets with na, sa, wa and nb, sb, wb fit in size and by both sketches."""
    return sizes_fit("na", "nb") & (odd_bits("wa", "wb", WHOLE_BITS) <= most_whole_bits("na", "nb")) & (odd_bits("sa", "sb", BITS) <= most)


def likely(pairs: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b) that fit in size and by their sketches."""
    side = lambda c: sets.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"), F.col("whole").alias(f"w{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(alike(most)).select("a", "b")


def verified(asked: DataFrame, tokens: DataFrame, parts: int) -> DataFrame:
    """Links among the asked pairs, by whole sets."""
    keys = asked.select(F.col("a").alias("key")).union(asked.select("b")).distinct()
    if asked.limit(FEW_KEYS // 2 + 1).count() <= FEW_KEYS // 2:  # so few keys that the others' sets need not be moved
        tokens = tokens.join(F.broadcast(keys), "key", "left_semi")
    return materialize(verify(asked, tokens), "odd_links", parts)


def remaining_pairs(left: DataFrame, most: int) -> DataFrame:
    """(a, b) of two roots out of left (bucket, key, n, sketch, whole, root, minor, ask_salts, salts) that share a bucket, fit in size and pass the sketches.

    One of them at least is not of the bucket's commonest root; such sets (minor) ask, all are asked. Both sides are
    dealt over salts, and each salt of the one meets each of the other, so no task has a whole bucket of either.
    """
    placed = left.withColumn("step", F.floor(F.log("n") / F.log(F.lit(1.26))))
    side = lambda c: [F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"), F.col("whole").alias(f"w{c}"), F.col("root").alias(f"r{c}")]
    dealt = lambda salts: F.pmod(F.xxhash64("key"), F.col(salts)).cast("int")
    every = lambda salts: F.explode(F.sequence(F.lit(0), F.col(salts) - 1))
    asks = placed.where("minor").select("bucket", "step", *side("a"), dealt("ask_salts").alias("x"), every("salts").alias("y"))
    told = placed.select("*", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("near"))
    told = told.select("bucket", F.col("near").alias("step"), *side("b"), F.col("minor").alias("asks_too"), dealt("salts").alias("y"), every("ask_salts").alias("x"))
    met = asks.join(told, ["bucket", "step", "x", "y"]).where((F.col("ra") != F.col("rb")) & (~F.col("asks_too") | (F.col("a") < F.col("b"))) & alike(most))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame, described: DataFrame, k: int = K) -> DataFrame:
    """(node, root) over set keys: components of verified links, for keys with a link."""
    most = most_odd_bits()
    sets = described.where("bands is not null").dropDuplicates(["key"])
    rows = sets.select("key", F.explode("bands").alias("bucket"))
    company = rows.groupBy("bucket").agg(F.count("*").alias("met")).where("met > 1")
    placed = materialize(rows.join(company, "bucket"), "odd_buckets")
    parts = 4 + placed.count() // ROWS_PER_TASK
    weights = placed.groupBy("key").agg(F.sum("met").alias("weight"))
    members = materialize(sets.join(weights, "key").select("key", "digest", "n", "sketch", "whole", "weight"), "odd_sets", parts)
    tokens = materialize(whole_sets(docs, members.select("digest").distinct(), k), "odd_tokens")
    step = F.floor(F.log("n") / F.log(F.lit(1.25))).alias("step")
    at = materialize(placed.join(members.select("key", "n", "weight"), "key").select("bucket", "key", "n", "weight", step), "odd_placed", parts)
    found: DataFrame | None = None
    roots: DataFrame | None = None

    def with_root(df: DataFrame) -> DataFrame:
        if roots is None:
            return df.withColumn("root", F.col("key"))
        return df.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))

    for turn in range(LEADER_ROUNDS):
        rooted = with_root(at)
        order = F.xxhash64("key", F.lit(turn))
        slot = F.lit(0) if turn == 0 else F.pmod(order, F.lit(LEADERS))
        lead = F.max(F.struct(F.col("weight") if turn == 0 else F.lit(0).alias("weight"), order.alias("o"), F.col("key").alias("lead"), F.col("root").alias("lead_root"), F.col("n").alias("lead_n"))).alias("x")
        leads = rooted.groupBy("bucket", "step", slot.alias("slot")).agg(lead).select("bucket", "step", "x.lead", "x.lead_root", "x.lead_n")
        met = rooted.join(leads, ["bucket", "step"]).where("root != lead_root").where(sizes_fit("n", "lead_n"))
        pairs = met.select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct()
        asked = materialize(likely(pairs, members, most), f"odd_asked{turn}", parts)
        new = verified(asked, tokens, parts)
        discard(asked)
        if turn == 0 or not new.isEmpty():
            found = new if found is None else found.union(new)
            old, roots = roots, connected_components(found)
            discard(old)
    # what still lies in two components
    rooted = materialize(with_root(at).select("bucket", "key", "root"), "odd_rooted", parts)
    per_root = rooted.groupBy("bucket", "root").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.sum("c").alias("met"), F.max(F.struct("c", "root")).alias("most"))
    salts = lambda c: F.ceil(c / PER_SALT).cast("int")
    mixed = per_root.where("met > most.c").select("bucket", F.col("most.root").alias("major"), salts(F.col("met")).alias("salts"), salts(F.col("met") - F.col("most.c")).alias("ask_salts"))
    left = rooted.join(mixed, "bucket").join(members.select("key", "n", "sketch", "whole"), "key").withColumn("minor", F.col("root") != F.col("major"))
    left = materialize(left, "odd_left", parts)
    asked = materialize(remaining_pairs(left, most), "odd_pairs", parts)
    last = verified(asked, tokens, parts)
    out = connected_components(found.union(last))
    discard(placed, members, tokens, at, rooted, left, asked, last, found, roots)
    return out


def near_duplicates(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    described = materialize(describe(docs, k), "odd_described")
    roots = links(docs, described, k)
    rows = described.select("doc_id", "n", "key").join(roots.withColumnRenamed("node", "key"), "key", "left")
    placed = materialize(rows.select("doc_id", "n", F.coalesce("root", "key").alias("root")), "odd_rows")
    discard(described, roots)
    least = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    out = placed.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
