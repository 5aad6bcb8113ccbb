"""Operator 7: n-gram Jaccard join by grouped prefixes.

Documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more are linked; the
result is each document's set size and component. Nothing is approximate but 64-bit hashes stand for
shingles and for whole sets (48 bits of them where two sets or frequencies are compared).

1. `describe` hashes every text: set size and set digest. Equal sets are one node from here on.
2. `survivors` finds each shingle's document frequency. Tasks send packed (shingle, row) runs to
   buckets of the hash space; a bucket counts each shingle's rows (equal sets of one task count once)
   and returns only the shingles of two rows or more, again packed, to the batch they came from. A set that shares less
   than 80 % of its shingles with the rest of the corpus can't have a partner and goes. Shingles so
   common that at most 131,072 of them can exist are announced first, and are not sent at all.
3. Each surviving set has a prefix, its rarest n - ceil(0.8 n) + 1 shingles. Sets with the same
   prefix and size form a group. Groups that share a prefix shingle and fit in size are candidates.
4. `links` verifies candidates. First rounds compare groups with a few leaders of a prefix shingle
   (the sets with fewest shingles of their own, so the likeliest originals) and members with the leader
   of their group, in proportion to the rows, and contract what is linked. The last round verifies
   the candidate pairs that are still in two components, so no link that joins components is lost, and
   no pair inside a component is made. A candidate must fit in size and by the places of the shared
   shingle: what stands behind it in both sets must suffice for the similarity. Sets meet by steps of
   size, and those of a frequent shingle in salts, so no task holds all of them.

Defined cases: null, empty and wordless texts have no shingles and their own component; fewer than
five words make one shingle; equal texts are linked; a null id keeps a null component and joins no
other row's; repeated ids give a row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm import text as tx
from gneiss.llm.common import discard, id_and_text, materialize, next_pow2
from gneiss.llm.components import connected_components

K = 5
COMMON = 1 << 17  # most shingles that can be announced as common
WINDOW = 1 << 21  # shingles that a task holds before it sends them
PER_BUCKET = 1 << 21
LEADER_ROUNDS = 3
LEADERS = 4
ROWS_PER_TASK = 100_000
PER_SALT = 1000  # sets of one shingle that meet as many others in one pair of salts of the last round
MAX_TASKS = 1 << 16
U64 = np.uint64


def least_overlap(n):
    """Shingles that a set of n shares at least with a partner of similarity 0.8."""
    return (4 * n + 4) // 5


def token48(h: np.ndarray) -> np.ndarray:
    return h >> U64(16)


# --- step 1 -----------------------------------------------------------------------------------------


def _new_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(slice, set keys, shingles, bounds, new): new marks the first sight of each set in this task."""
    seen: set[int] = set()
    for part, buf, o in tx.chunks(batches):
        h, first = tx.shingle_sets(tx.split_words(buf, o), k)
        keys = tx.set_key(h, first)[0]
        new = np.zeros(len(keys), bool)
        for i, key in enumerate(keys.tolist()):
            if first[i + 1] > first[i] and key not in seen:
                seen.add(key)
                new[i] = True
        yield part, keys, h, first, new


def describe(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n, key) for each document, and rows with a null n for shingles often met in one task (key) and how often (doc_id)."""

    def common(held: list[np.ndarray], size: int) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        often = c >= max(8, size // COMMON)
        return pa.RecordBatch.from_arrays([pa.array(c[often].astype(np.int64)), pa.nulls(int(often.sum()), pa.int64()), pa.array(h[often].view(np.int64))], names=["doc_id", "n", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for part, keys, h, first, new in _new_sets(batches, k):
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(keys, mask=n == 0)], names=["doc_id", "n", "key"])
            held.append(h[np.repeat(new, n)])
            size += len(held[-1])
            if size >= WINDOW:
                yield common(held, size)
                held, size = [], 0
        if size:
            yield common(held, size)

    return id_and_text(docs).mapInArrow(run, "doc_id long, n long, key long")


# --- step 2 -----------------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(arrays), *(len(a) * a.itemsize for a in arrays)], np.int64).tobytes(), *(a.tobytes() for a in arrays)])


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    count = int(np.frombuffer(blob, np.int64, 1)[0])
    at, out = 8 * (count + 1), []
    for size, kind in zip(np.frombuffer(blob, np.int64, count, 8).tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _send(docs: DataFrame, common: np.ndarray, buckets: int, k: int) -> DataFrame:
    """Packed runs for each bucket: (bucket, source, meta, blob). A source is one window of one task."""
    shift = U64(64 - (buckets.bit_length() - 1))

    def flush(held: list, source: int) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([x[0] for x in held])
        n = np.concatenate([x[1] for x in held])
        h = np.concatenate([x[2] for x in held])
        row = np.repeat(np.arange(len(keys), dtype=np.uint16), n)
        if len(common):
            is_common = np.isin(h, common)
            meta = _pack(keys, n, token48(h[is_common]), row[is_common])
            h, row = h[~is_common], row[~is_common]
        else:
            meta = _pack(keys, n, np.zeros(0, U64), np.zeros(0, np.uint16))
        order = np.argsort(h)
        h, row = h[order], row[order]
        cuts = np.searchsorted(h >> shift, np.arange(buckets + 1, dtype=U64))
        t = token48(h)
        low, high = (t & U64(0xFFFFFFFF)).astype(np.uint32), (t >> U64(32)).astype(np.uint16)
        blobs = [_pack(low[a:b], high[a:b], row[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b > a]
        full = np.flatnonzero(np.diff(cuts)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(full, source % buckets).astype(np.int32)), pa.array(np.full(len(full) + 1, source)), pa.array([False] * len(full) + [True]), pa.array([*blobs, meta], pa.binary())],
            names=["bucket", "source", "meta", "blob"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = rows = 0
        source = TaskContext.get().partitionId() << 20
        for _, keys, h, first, new in _new_sets(batches, k):
            n = np.diff(first)
            held.append((keys[new], n[new].astype(np.int32), h[np.repeat(new, n)]))
            size, rows = size + len(held[-1][2]), rows + int(new.sum())
            if size >= WINDOW or rows >= 40_000:
                yield from flush(held, source)
                held, size, rows, source = [], 0, 0, source + 1
        if rows:
            yield from flush(held, source)

    return id_and_text(docs).mapInArrow(run, "bucket int, source long, meta boolean, blob binary")


def _count(table: pa.Table) -> pa.Table:
    """In one bucket: shingles of two rows or more, with their frequency, for the sources that sent them."""
    is_meta = table["meta"].to_numpy(zero_copy_only=False)
    sources, blobs = table["source"].to_numpy(), table["blob"].to_pylist()
    out_source = sources[is_meta].tolist()
    out_meta = [True] * len(out_source)
    out_blob = [b for b, m in zip(blobs, is_meta.tolist(), strict=True) if m]
    runs = [(s, _unpack(b, np.uint32, np.uint16, np.uint16)) for s, b, m in zip(sources.tolist(), blobs, is_meta.tolist(), strict=True) if not m]
    if runs:
        token = np.concatenate([lo.astype(U64) | (hi.astype(U64) << U64(32)) for _, (lo, hi, _) in runs])
        row = np.concatenate([r for _, (_, _, r) in runs])
        run = np.repeat(np.arange(len(runs), dtype=np.int32), [len(r) for _, (_, _, r) in runs])
        order = np.argsort(token)
        s = token[order]
        same = s[1:] == s[:-1]
        again = np.zeros(len(s), bool)
        again[1:] |= same
        again[:-1] |= same
        at, t = order[again], s[again]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(t)))
        df = np.repeat(size, size).astype(np.uint32)
        back = np.argsort(run[at], kind="stable")
        at, df = at[back], df[back]
        cuts = np.searchsorted(run[at], np.arange(len(runs) + 1))
        for (src, _), a, b in zip(runs, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b > a:
                out_source.append(src)
                out_meta.append(False)
                out_blob.append(_pack(token[at[a:b]], row[at[a:b]], df[a:b]))
    return pa.table({"source": pa.array(out_source, pa.int64()), "meta": pa.array(out_meta, pa.bool_()), "blob": pa.array(out_blob, pa.binary())})


_SURVIVOR = "key long, n long, own long, prefix array<long>, tokens binary"


def _gather(table: pa.Table) -> pa.Table:
    """For one source: the sets that can have a partner, with their shared shingles and prefix."""
    keys = n = None
    tokens, rows, dfs = [], [], []
    for meta, blob in zip(table["meta"].to_pylist(), table["blob"].to_pylist(), strict=True):
        if meta:
            keys, n, t, r = _unpack(blob, np.int64, np.int32, U64, np.uint16)
            d = np.full(len(t), 2**32 - 1, np.uint32)
        else:
            t, r, d = _unpack(blob, U64, np.uint16, np.uint32)
        tokens.append(t)
        rows.append(r)
        dfs.append(d)
    t, r, d = np.concatenate(tokens), np.concatenate(rows), np.concatenate(dfs)
    shared = np.bincount(r, minlength=len(keys))
    stays = shared >= least_overlap(n.astype(np.int64))
    keep = stays[r]
    t, r, d = t[keep], r[keep], d[keep]
    order = np.lexsort((t, d, r))
    t, r = t[order], r[order]
    out: dict[str, list] = {"key": [], "n": [], "own": [], "prefix": [], "tokens": []}
    for i in np.flatnonzero(stays).tolist():
        a, b = np.searchsorted(r, [i, i + 1])
        mine, size = t[a:b], int(n[i])
        own = size - len(mine)  # shingles of this set alone are the rarest
        prefix = mine[: max(0, size - least_overlap(size) + 1 - own)]
        if not len(prefix):
            continue
        out["key"].append(int(keys[i]))
        out["n"].append(size)
        out["own"].append(own)
        out["prefix"].append(prefix.astype(np.int64))
        out["tokens"].append(np.sort(mine).tobytes())
    del tokens, rows, dfs, t, r, d, order
    tx.give_back()
    return pa.table({"key": pa.array(out["key"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "own": pa.array(out["own"], pa.int64()), "prefix": pa.array(out["prefix"], pa.list_(pa.int64())), "tokens": pa.array(out["tokens"], pa.binary())})


def survivors(docs: DataFrame, described: DataFrame, k: int = K) -> DataFrame:
    """(key, n, prefix, tokens) for each set that may have a partner."""
    total = described.where("n is not null").agg(F.sum("n")).first()[0] or 0
    often = described.where("n is null").groupBy("key").agg(F.sum("doc_id").alias("c")).where(F.col("c") * COMMON >= total)
    common = np.sort(np.array([x["key"] for x in often.select("key").toLocalIterator()], np.int64).view(U64))  # COMMON at most, since their counts add up to `total` at most
    buckets = next_pow2(total / PER_BUCKET, 64)
    counted = _send(docs, common, buckets, k).repartition(min(buckets, MAX_TASKS), "bucket").groupBy("bucket").applyInArrow(_count, "source long, meta boolean, blob binary")
    return counted.groupBy("source").applyInArrow(_gather, _SURVIVOR).dropDuplicates(["key"])


# --- steps 3 and 4 ----------------------------------------------------------------------------------


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set keys whose similarity is 0.8 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            na, nb = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), U64) for c in (3, 5))
                both = np.concatenate((x, y))
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * inter >= 80 * (int(na[i]) + int(nb[i]) - inter)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    side = lambda c: sets.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", "na", "ta", "nb", "tb").mapInArrow(run, "a long, b long")


def fits(n: str, pos: str, m: str, at: str) -> Column:
    """Whether sets of n and m that share a shingle at pos and at may overlap in 4/9 of n + m, as the similarity asks."""
    return F.expr(f"9 * least({n} - {pos}, {m} - {at}) >= 4 * ({n} + {m}) and 5 * least({n}, {m}) >= 4 * greatest({n}, {m})")


def unlinked_pairs(left: DataFrame) -> DataFrame:
    """(a, b) of keys with a common token, of two roots, that fit in size and place.

    Sizes that fit lie in the same step of a factor 1.26 or in two that touch, so only those meet. The sets of a
    token are dealt over its salts on both sides, and each salt of the one meets each of the other, so a task holds
    about PER_SALT sets of a token from either side.
    """
    own = F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    placed = left.withColumn("step", F.floor(F.log("n") / F.log(F.lit(1.26))))
    dealt = placed.select("*", own.alias("salt"), every.alias("salt_b"))
    other = placed.select(F.col("key").alias("b"), F.col("n").alias("m"), "token", F.col("pos").alias("at"), F.col("root").alias("root_b"), F.col("step").alias("step_b"), own.alias("salt_b"), every.alias("salt"))
    other = other.withColumn("step", F.explode(F.array(F.col("step_b"), F.col("step_b") + 1)))
    met = dealt.drop("salts").join(other, ["token", "step", "salt", "salt_b"]).where("step_b < step or key < b").where("root != root_b").where(fits("n", "pos", "m", "at"))
    return met.select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b")).distinct()


def links(sets: DataFrame) -> DataFrame:
    """(node, root) over set keys: components of verified links, for keys with a link."""
    parts = 4 + sets.select(F.sum(F.size("prefix"))).first()[0] // ROWS_PER_TASK if not sets.isEmpty() else 4
    named = sets.withColumn("g", F.xxhash64("n", "prefix"))
    members = materialize(named.select("key", "n", "own", "g"), "members", parts)
    heads = materialize(members.groupBy("g").agg(F.min(F.struct("own", "key")).alias("x"), F.count("*").alias("size")).select("g", F.col("x.key").alias("head"), "size"), "heads", parts)
    tokens = materialize(named.select("key", "n", "own", "g", F.posexplode("prefix").alias("i", "token")).withColumn("pos", F.col("own") + F.col("i")), "tokens", parts)
    step = F.floor(F.log("n") / F.log(F.lit(1.25)))
    group_tokens = materialize(tokens.join(heads.select(F.col("head").alias("key")), "key").select("key", "n", "own", "token", "pos"), "group_tokens", parts)
    found: DataFrame | None = None
    roots: DataFrame | None = None

    def with_root(df: DataFrame) -> DataFrame:
        if roots is None:
            return df.withColumn("root", F.col("key"))
        return df.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))

    for turn in range(LEADER_ROUNDS):
        at = materialize(with_root(group_tokens if turn == 0 else tokens).select("key", "n", "own", "token", "pos", "root", step.alias("step")), f"placed{turn}", parts)
        slot = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(LEADERS))
        lead = F.struct("own" if turn < LEADER_ROUNDS - 1 else F.lit(0).alias("own"), F.xxhash64("key", F.lit(turn)).alias("o"), F.col("key").alias("lead"), F.col("n").alias("lead_n"), F.col("pos").alias("lead_pos"), F.col("root").alias("lead_root"))
        leads = materialize(at.groupBy("token", "step", slot.alias("slot")).agg(F.min(lead).alias("x")).select("token", "step", "slot", "x.*"), f"leads{turn}", parts)
        met = at.drop("own").join(leads, ["token", "step"]).where("root != lead_root").where(fits("n", "pos", "lead_n", "lead_pos"))
        votes = met.groupBy("key", "slot", "lead").agg(F.count("*").alias("c"))
        pairs = votes.groupBy("key", "slot").agg(F.max(F.struct("c", "lead")).alias("x")).select(F.col("x.lead").alias("a"), F.col("key").alias("b"))
        if turn == 0:
            pairs = pairs.union(members.join(heads.where("size > 1"), "g").where("key != head").select(F.col("head").alias("a"), F.col("key").alias("b")))
        asked = materialize(pairs.distinct(), f"pairs{turn}", parts)
        new = materialize(verify(asked, sets), f"links{turn}", parts)
        discard(at, leads, asked)
        if turn == 0 or not new.isEmpty():
            found = new if found is None else found.union(new)
            old, roots = roots, connected_components(found)
            discard(old)
    # what still lies in two components
    placed = materialize(with_root(tokens), "placed", parts)
    mixed = placed.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("met")).where("r0 < r1")
    mixed = materialize(mixed.select("token", F.ceil(F.col("met") / PER_SALT).cast("int").alias("salts")), "mixed", parts)
    left = materialize(placed.join(mixed, "token").select("key", "n", "token", "pos", "root", "salts"), "left", parts)
    pairs = unlinked_pairs(left)
    asked = materialize(pairs, "pairs", parts)
    last = materialize(verify(asked, sets), "last_links", parts)
    discard(members, heads, tokens, group_tokens, placed, mixed, left, asked, roots)
    return connected_components(found.union(last))


def jaccard_components(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    described = materialize(describe(docs, k), "described")
    sets = materialize(survivors(docs, described, k), "survivors")
    roots = links(sets)
    rows = described.where("n is not null")
    placed = materialize(rows.join(roots.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "n", F.coalesce("root", "key").alias("root")), "rows")
    discard(described, sets, roots)
    least = materialize(placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least_ids")
    out = placed.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, that of the smallest id; a row without an id only where no other has one.

    Rows, not ids, are grouped: repeated rows and rows without an id are copies too, and rows that share an
    id may be of several components. Rows without a word have no copies but equal rows.
    """
    row = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = id_and_text(docs).select("doc_id", "text", row.alias("row"))
    placed = jaccard_components(keyed.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id").distinct()
    ids = keyed.select("row", "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("x")
    chosen = materialize(placed.join(ids, "row").groupBy("component_id").agg(first).select("x.row"), "chosen")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row.alias("row"))
    return whole.dropDuplicates(["row"]).join(chosen, "row", "left_semi").select("doc.*")
