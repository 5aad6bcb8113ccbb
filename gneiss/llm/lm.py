"""Operator 8: language-model scoring by logistic context mixing.

A text is its words, A-Z lower-cased, and one end mark; its probability is that of this sequence, with
the words that training never saw as symbols of their own, one for each ending class. Frequent words are
symbols; all others are the class of their last two bytes, and share the class's probability by their
exact counts, with as much left for unseen words as the class has words met once. Each symbol is a path
of bits in a Huffman tree, and each bit is predicted by mixing the node's own share with hashed contexts:
the word before, and the last two common words. The predictors' logits are combined by weights chosen by
a gate (how often the contexts were seen), and refined by an adaptive map from the mixed logit and the
bit's depth to a probability. While a text is scored its own weights go on learning, `STEP` words at a
time, so the mix follows the text. For bits_per_byte the unseen words are spelled as well: a second mixer
predicts their bytes from up to three bytes before, so that number is what the whole text takes.

What is gathered grows with the corpus:

1. `count_words`: tasks send their distinct words' counts, packed by hash range; ranges add them up. This
   gives the exact counts of the base score, the classes' sums, and from the most frequent words the
   vocabulary, whose size grows with the root of the training tokens (`vocabulary_size`).
2. `count_contexts`: tasks count bits by context slot over all training texts, apart for two halves of
   them; the tables are added up slot range by slot range. Their size grows with the training tokens up to
   2**MAX_BITS slots, which every worker must hold (48 MB); beyond that, at about 4 billion tokens, contexts
   share slots, and the gate and weights learned on unseen texts lessen what they say.
3. `fit_mixers`: weights and maps are learned on all training texts, each half by the tables of the other,
   which have not seen it. Tasks count the bits by their gate and inputs, rounded to steps of a logit; from
   the sums, whole numbers that no layout changes, the driver takes the best weights of each gate and the
   map. Then the halves' tables are added up.
4. `lm_scores`: every text is scored where it lies. Counts of frequent words are known to all tasks (a
   bounded list); entries of all other words go to their hash range and come back as sums.

Words are known by 64-bit hashes. Defined cases: a null or empty text is the end mark alone; repeated
rows give a row each and count each; rows with a null id train and are scored, with a null id; with no
training text every count is 0; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import text as tx
from gneiss.llm.common import digest_mod, discard, id_and_text, materialize, next_pow2
from gneiss.llm.jaccard import _pack, _unpack

U64 = np.uint64
U32 = np.uint32
F32 = np.float32
END = U64(0x2545F4914F6CDD1D)  # hash of the end mark
CLASSES = 64  # of the words outside the vocabulary
COMMON = 63  # most frequent words that make the second context
MAX_VOCABULARY = 1 << 16
MAX_BITS = 22
LETTER_BITS = (10, 16, 18)
HELD_WORDS = 1 << 21
LOGIT_STEP = 0.5  # of the contexts' logits where bits are counted by their inputs
OWN_STEPS = 24  # of the nodes' own shares there
PRIOR = 16.0  # bits' worth of trust in the weights and the map that nothing was learned for
CHUNK = 2 << 20
STEP = 128  # words between two updates of a text's own weights
RATE = 0.6
LEVELS = 4
CELLS = 33
FINE = 32  # steps a unit of the final map
BLOCK = 1 << 12
INPUTS_BLOCK = 1 << 16


def vocabulary_size(tokens: int) -> int:
    return min(max(next_pow2(math.sqrt(tokens) / 8), 256), MAX_VOCABULARY)


def table_bits(tokens: int) -> int:
    return min(max(int(math.log2(tokens + 1)) - 7, 14), MAX_BITS)


# --- symbols as paths of bits -----------------------------------------------------------------------


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, nodes, bits): symbol s has the path nodes[first[s]:first[s + 1]]."""
    heap = [(int(c) + 1, s, None) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    number = len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], number, (a, b)))
        number += 1
    paths: dict[int, list[tuple[int, int]]] = {}
    todo = [(heap[0], [])]
    while todo:
        (_, name, kids), path = todo.pop()
        if kids is None:
            paths[name] = path
        else:
            node = name - len(counts)
            todo += [(kids[0], [*path, (node, 0)]), (kids[1], [*path, (node, 1)])]
    flat = [x for s in range(len(counts)) for x in paths[s]]
    first = np.concatenate([[0], np.cumsum([len(paths[s]) for s in range(len(counts))])])
    return first, np.array([x[0] for x in flat], np.int64), np.array([x[1] for x in flat], np.uint8)


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -20, 20)))


def mix32(h: np.ndarray) -> np.ndarray:
    """32 well-mixed bits of 64-bit keys."""
    return (tx.mix(h) >> U64(32)).astype(U32)


class Mixer:
    """Bit predictors over the empty and several hashed contexts, their gated weights and the adaptive map behind them."""

    def __init__(self, counts: np.ndarray, sizes: tuple[int, ...]):
        """counts: of the symbols in training; sizes: bits of each hashed context's table."""
        self.sizes = sizes
        self.first, nodes, bits = huffman(counts)
        self.length = np.diff(self.first).astype(np.int32)
        self.bits = bits.astype(np.int32)
        self.depth = np.minimum(np.arange(len(nodes)) - np.repeat(self.first[:-1], self.length), 7).astype(np.int32)
        self.node = mix32(nodes.astype(U64) + U64(1))
        weight = np.repeat(counts.astype(np.float64), self.length)
        both = [np.bincount(nodes, weight * (bits == b), max(len(counts) - 1, 1)) for b in (0, 1)]
        self.alone = np.clip(stretch((both[1] + 0.4) / (both[0] + both[1] + 0.8)), -11, 11)[nodes].astype(F32)
        self.tables: list[np.ndarray] = []
        gated = min(len(sizes), 2)
        self.codes = [table_codes(False)] * (len(sizes) - gated) + [table_codes(True)] * gated
        self.shape = (8, 2, OWN_STEPS, *(len(c.logits) for c in self.codes))  # depth, bit, own share, contexts
        order = np.argsort(self.alone, kind="stable")
        reached = np.cumsum(weight[order] + 1 / (1 + len(order)))
        own = np.zeros(len(order), np.int64)
        own[order] = np.minimum(OWN_STEPS * (reached / (reached[-1] if len(order) else 1)), OWN_STEPS - 1)
        self.own_logits = np.bincount(own, self.alone * (weight + 1e-9), OWN_STEPS) / np.maximum(np.bincount(own, weight + 1e-9, OWN_STEPS), 1e-9)
        self.fixed = ((self.depth * 2 + self.bits) * OWN_STEPS + own).astype(np.int16)
        self.weights = np.full((LEVELS ** min(len(sizes), 2), len(sizes) + 1), 1.0 / (len(sizes) + 1), F32)
        self.cells = np.tile(squash(np.linspace(-8, 8, CELLS)).astype(F32), (8, 1))

    def path(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol of each bit, its place among all symbols' bits)."""
        size = self.length[symbols]
        edge = np.cumsum(size)
        owner = np.repeat(np.arange(len(symbols), dtype=np.int32), size)
        at = np.arange(edge[-1] if len(edge) else 0, dtype=np.int64) + (self.first[symbols] - edge + size)[owner]
        return owner, at

    def slots(self, owner: np.ndarray, at: np.ndarray, contexts: list[np.ndarray]) -> list[np.ndarray]:
        node = self.node[at]
        return [((c[owner] ^ node) * U32(0x9E3779B1)) >> U32(32 - b) for c, b in zip(contexts, self.sizes, strict=True)]

    def count(self, symbols: np.ndarray, contexts: list[np.ndarray], into: list[np.ndarray], times: np.ndarray | None = None) -> None:
        """Add the symbols' bits, `times` each, to the tables of counts."""
        for a in range(0, len(symbols), 1 << 15):
            owner, at = self.path(symbols[a : a + (1 << 15)])
            bits = self.bits[at].astype(U32)
            n = U32(1) if times is None else times[a : a + (1 << 15)].astype(U32)[owner]
            for s, t in zip(self.slots(owner, at, [c[a : a + (1 << 15)] for c in contexts]), into, strict=True):
                np.add.at(t, s + s + bits, n)

    def empty(self) -> list[np.ndarray]:
        return [np.zeros(2 << b, U32) for b in self.sizes]

    def settle(self, counts: list[np.ndarray]) -> None:
        """Logits and gate levels from the counts, packed in 16 bits: 512ths of a unit, then the level."""
        self.tables = []
        for t in counts:
            n = t.reshape(-1, 2).astype(F32)
            both = n.sum(axis=1)
            logit = np.clip(np.rint(512 * stretch((n[:, 1] + F32(0.4)) / (both + F32(0.8)))), -5632, 5632).astype(np.int16)
            level = np.minimum(np.log2(both + 1) / 2, LEVELS - 1).astype(np.int16)
            self.tables.append((logit << 2) | level)

    def inputs(self, owner: np.ndarray, at: np.ndarray, contexts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """(logits of the predictors, gate) of each bit."""
        logits, gate = [self.alone[at]], None
        for j, s in enumerate(self.slots(owner, at, contexts)):
            x = self.tables[j][s]
            logits.append((x >> 2).astype(F32) * F32(1 / 512))
            if j >= len(self.sizes) - 2:
                level = (x & 3).astype(np.int32)
                gate = level if gate is None else gate * LEVELS + level
        return logits, gate

    def mixed(self, logits: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z = logits[0] * self.weights[gate, 0]
        for j in range(1, len(logits)):
            z += logits[j] * self.weights[gate, j]
        return z

    def cell(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (np.clip(z, -7.999, 7.999) + 8) * ((CELLS - 1) / 16)
        i = x.astype(np.int64)
        return i, (x - i).astype(F32)

    def final_map(self) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each bit by [bit, depth, place of z], and the probability of a 1 by [depth, place]: half the plain curve, half the learned cells."""
        z = (np.arange(24 * FINE + 1) - 12 * FINE) / FINE
        i, part = self.cell(z)
        p = np.clip((squash(z) + self.cells[:, i] * (1 - part) + self.cells[:, i + 1] * part) / 2, 1e-6, 1 - 1e-6)
        return np.log10(np.stack([1 - p, p])).astype(F32).reshape(2, -1), p.astype(F32).ravel()

    def place(self, z: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.clip(z * F32(FINE) + F32(12 * FINE + 0.5), 0, 24 * FINE).astype(np.int32) + self.depth[at] * (24 * FINE + 1)

    def cost(self, symbols: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """log10 of each symbol's probability, with the weights as they were learned."""
        out = np.zeros(len(symbols))
        logs, _ = self.final_map()
        for a in range(0, len(symbols), 1 << 14):
            part = symbols[a : a + (1 << 14)]
            owner, at = self.path(part)
            logits, gate = self.inputs(owner, at, [c[a : a + (1 << 14)] for c in contexts])
            out[a : a + (1 << 14)] = np.bincount(owner, logs[self.bits[at], self.place(self.mixed(logits, gate), at)], len(part))
        return out

    def follow(self, symbols: np.ndarray, contexts: list[np.ndarray], first: np.ndarray, rate: float = RATE) -> np.ndarray:
        """log10 probability of each text symbols[first[i]:first[i + 1]]; a text's weights learn from each of its steps for the next."""
        texts = len(first) - 1
        step = (np.arange(len(symbols)) - np.repeat(first[:-1], np.diff(first))) // STEP
        order = np.argsort(step, kind="stable")
        text = np.repeat(np.arange(texts), np.diff(first))
        cuts = np.searchsorted(step[order], np.arange(int(step.max()) + 2 if len(step) else 1))
        own = np.zeros((texts, len(self.sizes) + 1), F32)
        out = np.zeros(texts)
        logs, ones = self.final_map()
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            for a, b in whole_runs(text[order[lo:hi]], 1 << 14):
                mine = order[lo + a : lo + b]
                owner, at = self.path(symbols[mine])
                logits, gate = self.inputs(owner, at, [c[mine] for c in contexts])
                z = self.mixed(logits, gate)
                here, inside = np.unique(text[mine], return_inverse=True)
                who = inside.astype(np.int32)[owner]
                if lo:
                    for j, x in enumerate(logits):
                        z += own[here, j][who] * x
                at_map, bits = self.place(z, at), self.bits[at]
                out[here] += np.bincount(who, logs[bits, at_map], len(here))
                if hi < len(order):
                    error = bits - ones[at_map]
                    n = np.bincount(who, minlength=len(here)) + 64.0
                    for j, x in enumerate(logits):
                        own[here, j] = np.clip(own[here, j] + rate / 8 * np.bincount(who, error * x, len(here)) / n, -1, 1)
        return out

    def coded(self) -> list[np.ndarray]:
        """The settled tables' codes, a byte a slot."""
        return [c.of[t.view(np.uint16)] for c, t in zip(self.codes, self.tables, strict=True)]

    def kinds(self, symbols: np.ndarray, contexts: list[np.ndarray], coded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(symbol of each bit, its kind): the place in `shape` of its depth, itself and its rounded inputs."""
        owner, at = self.path(symbols)
        kind = self.fixed[at].astype(np.int32)
        for slot, table, codes in zip(self.slots(owner, at, contexts), coded, self.codes, strict=True):
            kind *= len(codes.logits)
            kind += table[slot]
        return owner, kind

    def learn(self, symbols: np.ndarray, contexts: list[np.ndarray]) -> None:
        """Weights and map from these symbols alone."""
        self.fit(*np.unique(self.kinds(symbols, contexts, self.coded())[1], return_counts=True))

    def fit(self, kinds: np.ndarray, n: np.ndarray) -> None:
        """The weights of each gate that give n bits of these kinds the highest probability, and the map from what they mix to the share of ones."""
        depth, y, own, *places = np.unravel_index(kinds, self.shape)
        x = np.stack([self.own_logits[own], *(c.logits[i] for c, i in zip(self.codes, places, strict=True))], axis=1)
        gate = np.zeros(len(kinds), np.int64)
        for c, i in list(zip(self.codes, places, strict=True))[-2:]:
            gate = gate * LEVELS + c.levels[i]
        y, n = y.astype(float), n.astype(float)
        z = np.zeros(len(kinds))
        for g in np.unique(gate).tolist():
            mine = gate == g
            self.weights[g] = best_weights(x[mine], y[mine], n[mine])
            z[mine] = x[mine] @ self.weights[g]
        i, share = self.cell(z)
        hits, size = PRIOR * squash(np.linspace(-8, 8, CELLS)) * np.ones((8, 1)), np.full((8, CELLS), PRIOR)
        for at, part in ((i, 1 - share), (i + 1, share)):
            np.add.at(hits, (depth, at), n * part * y)
            np.add.at(size, (depth, at), n * part)
        self.cells = np.clip(hits / size, 1e-5, 1 - 1e-5).astype(F32)


@dataclass
class Codes:
    """Rounded logits of a table's slots."""

    of: np.ndarray  # code by the slot's 16 bits
    logits: np.ndarray  # of each code
    levels: np.ndarray  # of each code


def table_codes(gated: bool) -> Codes:
    """Of tables whose level opens a gate by level, each as far as its logits reach; of others by the logit alone."""
    most = [math.log((4 ** (level + 1) - 1.6) / 0.4) for level in range(LEVELS - 1 if gated else 0)] + [11.0]
    reach = np.array([round(x / LOGIT_STEP) for x in most])
    begin = np.concatenate([[0], np.cumsum(2 * reach + 1)[:-1]])
    packed = np.arange(1 << 16).astype(np.uint16).view(np.int16)
    level = packed & 3 if gated else np.zeros(1 << 16, np.int64)
    of = begin[level] + reach[level] + np.clip(np.rint((packed >> 2) / (512 * LOGIT_STEP)), -reach[level], reach[level])
    logits = np.concatenate([np.arange(-r, r + 1) * LOGIT_STEP for r in reach.tolist()])
    return Codes(of.astype(np.uint8), logits, np.repeat(np.arange(len(reach)), 2 * reach + 1))


def best_weights(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logistic regression of y on x, each row n times, by Newton steps that are halved where they go too far; drawn to equal weights."""
    start = np.full(x.shape[1], 1.0 / x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(n @ (np.logaddexp(0, z) - y * z) + PRIOR / 2 * ((w - start) ** 2).sum())

    w, now = start, loss(start)
    for _ in range(30):
        p = squash(x @ w)
        slope = x.T @ (n * (p - y)) + PRIOR * (w - start)
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + PRIOR * np.eye(len(w)), slope)
        while (then := loss(w - step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if then >= now:
            break
        w, now = w - step, then
    return w


class Tally:
    """How often keys came, as one sorted list and the fresh ones behind it."""

    def __init__(self):
        self.keys, self.times, self.fresh = [], [], 0

    def add(self, keys: np.ndarray, times: np.ndarray) -> None:
        self.keys.append(keys)
        self.times.append(times)
        self.fresh += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) != 1:
            keys = np.concatenate([np.zeros(0, np.int64), *self.keys])
            u, back = np.unique(keys, return_inverse=True)
            self.keys, self.times = [u], [np.bincount(back, np.concatenate([np.zeros(0), *self.times]), len(u)).astype(np.int64)]
        self.fresh = 0
        return self.keys[0], self.times[0]


def whole_runs(owner: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about `size` that cut no run of equal owners, so that no piece sees what another of the same text has taught."""
    ends = np.append(np.flatnonzero(np.diff(owner)) + 1, len(owner))
    a = 0
    while a < len(owner):
        k = max(int(np.searchsorted(ends, a + size, "right")) - 1, int(np.searchsorted(ends, a, "right")))
        yield a, int(ends[k])
        a = int(ends[k])


# --- texts as symbols -------------------------------------------------------------------------------


def with_ends(w: tx.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end mark behind each document, each token's class, and the documents' bounds."""
    docs = len(w.first) - 1
    first = w.first + np.arange(docs + 1)
    out = np.full(first[-1], END, U64)
    kinds = np.zeros(first[-1], np.uint8)
    is_word = np.ones(first[-1], bool)
    is_word[first[1:] - 1] = False
    out[is_word] = w.hashes
    kinds[is_word] = word_class(w)
    return out, kinds, first


def word_class(w: tx.Words) -> np.ndarray:
    """The class of each word, by its last two bytes."""
    if not len(w.starts):
        return np.zeros(0, np.uint8)
    last = tx._FOLD[w.buf[w.ends - 1]].astype(U64)
    before = np.where(w.ends - w.starts > 1, tx._FOLD[w.buf[np.maximum(w.ends - 2, 0)]], 0).astype(U64)
    return (mix32(last + before * U64(256)) % U32(CLASSES)).astype(np.uint8)


def lookup(sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index in sorted_hashes, or -1."""
    if not len(sorted_hashes):
        return np.full(len(h), -1)
    i = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[i] == h, i, -1)


class Index:
    """Place of a hash in a sorted list, or -1, by its high bits first."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = max(next_pow2(4 * len(hashes), 2).bit_length() - 1, 1)
        cuts = np.searchsorted(hashes, np.arange(1 << self.bits, dtype=U64) << U64(64 - self.bits))
        self.cuts = np.append(cuts, len(hashes)).astype(np.int32)
        self.deepest = int(np.diff(self.cuts).max()) if len(hashes) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        bucket = (h >> U64(64 - self.bits)).astype(np.int64)
        at, end = self.cuts[bucket], self.cuts[bucket + 1]
        for k in range(self.deepest):
            i = at + k
            ok = (i < end) & (self.hashes[np.minimum(i, len(self.hashes) - 1)] == h)
            out[ok] = i[ok]
        return out


@dataclass
class Model:
    frequent: np.ndarray  # sorted hashes
    frequent_counts: np.ndarray
    symbol: np.ndarray  # of each frequent word; -1 for those outside the vocabulary
    size: int  # of the vocabulary; class k is symbol size + k
    kinds: np.ndarray  # class sums outside the vocabulary: [tokens, words met once]
    words: Mixer
    letters: Mixer
    total: int = 0
    distinct: int = 0
    index: Index = field(init=False)

    def __post_init__(self):
        self.index = Index(self.frequent)

    def symbols(self, at: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Symbols of tokens by their places in the frequent list and their classes."""
        s = np.where(at >= 0, self.symbol[np.maximum(at, 0)], -1) if len(self.symbol) else np.full(len(at), -1)
        return np.where(s >= 0, s, self.size + kinds.astype(np.int64))

    def word_contexts(self, symbols: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """The symbol before, and the last two common words, of each symbol of the texts."""
        n = len(symbols)
        begin = np.repeat(first[:-1], np.diff(first))
        one = np.zeros(n, np.int64)
        one[1:] = symbols[:-1] + 1
        one[first[:-1][first[:-1] < n]] = 0
        places = np.flatnonzero(symbols < min(COMMON, self.size))
        met = np.searchsorted(places, np.arange(n))  # common words before each place
        two = np.zeros(n, np.int64)
        for back, scale in ((1, 1), (2, COMMON + 1)):
            i = met - back
            at = places[np.maximum(i, 0)] if len(places) else np.zeros(n, np.int64)
            ok = (i >= 0) & (at >= begin) if len(places) else np.zeros(n, bool)
            two += np.where(ok, symbols[at] + 1, 0) * scale
        return [mix32(one.astype(U64) + U64(1 << 40)), mix32(two.astype(U64) + U64(2 << 40))]


def spell(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, word) for each byte of the words and the end behind each: the symbol and the three before it, nine bits each."""
    size = ends - starts + 1
    edge = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(starts), dtype=np.int32), size)
    inside = np.arange(edge[-1]) - edge[:-1][owner]
    at = starts[owner] + inside
    gram = np.where(at == ends[owner], 256, tx._FOLD[buf[np.minimum(at, len(buf) - 1)]].astype(np.int64))  # of bytes, 256 would be 0
    symbol = gram.copy()
    for k in (1, 2, 3):
        x = np.zeros(len(symbol), np.int64)
        x[k:] = symbol[:-k] + 1
        x[inside < k] = 0
        gram |= x << (9 * k)
    return gram, owner


def letter_contexts(gram: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(symbol, contexts of one, two and three bytes before) of grams."""
    g = gram.astype(U64) >> U64(9)
    return gram & 511, [mix32((g & U64((1 << (9 * k)) - 1)) + U64(k << 40)) for k in (1, 2, 3)]


class Scorer:
    """Scores texts with a model; costs of byte grams are kept within a task."""

    def __init__(self, model: Model):
        self.model = model
        self.grams = np.full(1 << 20, -1, np.int64)
        self.costs = np.zeros(1 << 20, F32)

    def spelled(self, w: tx.Words, where: np.ndarray) -> np.ndarray:
        """log10 probability of spelling the words at these places."""
        out = [np.zeros(0)]
        for a in range(0, len(where), 50_000):
            part = where[a : a + 50_000]
            gram, owner = spell(w.buf, w.starts[part], w.ends[part])
            slot = (mix32(gram.astype(U64)) >> U32(12)).astype(np.int64)
            cost = self.costs[slot]
            miss = np.flatnonzero(self.grams[slot] != gram)
            if len(miss):
                new, back = np.unique(gram[miss], return_inverse=True)
                fresh = self.model.letters.cost(*letter_contexts(new))
                cost[miss] = fresh[back]
                at = (mix32(new.astype(U64)) >> U32(12)).astype(np.int64)
                self.grams[at] = new
                self.costs[at] = fresh  # of two new grams at one place the last stays in both
            out.append(np.bincount(owner, cost, len(part)))
        return np.concatenate(out)

    def score(self, at: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability of each document's symbols, the symbols)."""
        symbol = self.model.symbols(at, kinds)
        return self.model.words.follow(symbol, self.model.word_contexts(symbol, first), first), symbol


# --- step 1 -----------------------------------------------------------------------------------------


def count_words(train: DataFrame, buckets: int, frequent: int) -> DataFrame:
    """(bucket, n, distinct, counts, top, kinds, letters): word counts by hash range, and sums by class and byte."""
    shift = U64(64 - (buckets.bit_length() - 1))

    def flush(h: np.ndarray, n: np.ndarray, kind: np.ndarray, letters: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.searchsorted(h >> shift, np.arange(buckets + 1, dtype=U64))
        full = np.flatnonzero(np.diff(cuts)).tolist()
        blobs = [_pack(h[cuts[b] : cuts[b + 1]], n[cuts[b] : cuts[b + 1]], kind[cuts[b] : cuts[b + 1]]) for b in full]
        letter = [letters.tobytes()] + [None] * (len(full) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary()), pa.array(letter, pa.binary())], names=["bucket", "blob", "letters"])

    def summed(h: np.ndarray, n: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, at, back = np.unique(h, return_index=True, return_inverse=True)
        return u, np.bincount(back, n).astype(np.int64), kind[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        fresh: list[tuple] = []
        size = 0
        letters = np.zeros(257, np.int64)
        for _, buf, o in tx.chunks(batches, limit=CHUNK):
            w = tx.split_words(buf, o)
            tokens, kinds, _ = with_ends(w)
            u, at, c = np.unique(tokens, return_index=True, return_counts=True)
            fresh.append((u, c, kinds[at]))
            size += len(u)
            letters[:256] += np.bincount(tx._FOLD[buf], minlength=256)
            letters[256] += len(w.starts)
            if size > max(len(held[0]), HELD_WORDS // 4):
                held, fresh, size = summed(*(np.concatenate(x) for x in zip(held, *fresh, strict=True))), [], 0
                if len(held[0]) > HELD_WORDS:
                    yield from flush(*held, letters)
                    held, letters = tuple(x[:0] for x in held), np.zeros(257, np.int64)
        if fresh or len(held[0]):
            yield from flush(*summed(*(np.concatenate(x) for x in zip(held, *fresh, strict=True))), letters)

    def add(table: pa.Table) -> pa.Table:
        runs = [_unpack(b, U64, np.int64, np.uint8) for b in table["blob"].to_pylist()]
        h, n, kind = summed(*(np.concatenate(x) for x in zip(*runs, strict=True)))
        most = np.argsort(-n, kind="stable")[: max(64, 4 * frequent // buckets)]
        letters = np.zeros(257, np.int64)
        for x in table["letters"].to_pylist():
            if x is not None:
                letters += np.frombuffer(x, np.int64)
        kinds = np.stack([np.bincount(kind, n, CLASSES), np.bincount(kind[n == 1], minlength=CLASSES)]).astype(np.int64)
        return pa.table(
            {
                "bucket": table["bucket"].slice(0, 1),
                "n": pa.array([int(n.sum())], pa.int64()),
                "distinct": pa.array([len(h)], pa.int64()),
                "counts": pa.array([_pack(h, n)], pa.binary()),
                "top": pa.array([_pack(h[most], n[most], kind[most])], pa.binary()),
                "kinds": pa.array([kinds.tobytes()], pa.binary()),
                "letters": pa.array([letters.tobytes()], pa.binary()),
            }
        )

    sent = train.select("text").mapInArrow(run, "bucket int, blob binary, letters binary")
    return sent.groupBy("bucket").applyInArrow(add, "bucket int, n long, distinct long, counts binary, top binary, kinds binary, letters binary")


def start_model(counted: DataFrame) -> Model:
    """Vocabulary, codes and frequent counts; a few times MAX_VOCABULARY words and the buckets' sums reach the driver."""
    total, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    vocabulary = vocabulary_size(total)
    h, n, kind = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    letters, kinds = np.zeros(257, np.int64), np.zeros((2, CLASSES), np.int64)
    for r in counted.select("top", "kinds", "letters").toLocalIterator():
        for x, y in zip((h, n, kind), _unpack(r["top"], U64, np.int64, np.uint8), strict=True):
            x.append(y)
        letters = letters + np.frombuffer(r["letters"], np.int64)
        kinds = kinds + np.frombuffer(r["kinds"], np.int64).reshape(2, CLASSES)
    h, n, kind = np.concatenate(h), np.concatenate(n), np.concatenate(kind)
    most = np.lexsort((h, -n))[: 8 * vocabulary]
    h, n, kind = h[most], n[most], kind[most]
    inside = min(vocabulary, len(h))
    kinds[0] -= np.bincount(kind[:inside], n[:inside], CLASSES).astype(np.int64)
    kinds[1] -= np.bincount(kind[:inside][n[:inside] == 1], minlength=CLASSES)
    kinds[1] += 1  # an unseen word is possible in every class
    symbol = np.where(np.arange(len(h)) < inside, np.arange(len(h)), -1)
    order = np.argsort(h)
    bits = table_bits(total)
    return Model(h[order], n[order], symbol[order], inside, kinds, Mixer(np.concatenate([n[:inside], kinds[0]]), (bits, bits)), Mixer(letters, LETTER_BITS), total, distinct)


# --- steps 2 and 3 ----------------------------------------------------------------------------------


def count_contexts(train: DataFrame, model: Model) -> DataFrame:
    """(t, block, counts): bit counts of both mixers' context tables, by blocks of slots. train has text and half; the second half's tables come after the first's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, tuple] = {}
        for part, buf, o in tx.chunks(batches, limit=CHUNK):
            w = tx.split_words(buf, o)
            tokens, kinds, first = with_ends(w)
            at = model.index.find(tokens)
            symbol = model.symbols(at, kinds)
            contexts = model.word_contexts(symbol, first)
            half = part.column(1).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(half)), np.diff(first))
            rare = np.flatnonzero(at < 0)
            rare = rare[tokens[rare] != END]
            for kind in np.unique(half).tolist():
                if kind not in sets:
                    sets[kind] = model.words.empty(), model.letters.empty(), Tally()
                words, letters, grams = sets[kind]
                mine = half[doc] == kind
                model.words.count(symbol[mine], [c[mine] for c in contexts], words)
                places = rare[mine[rare]]
                grams.add(*np.unique(spell(buf, *(x[places - doc[places]] for x in (w.starts, w.ends)))[0], return_counts=True))
                if grams.fresh > HELD_WORDS // 2:
                    u, n = grams.merged()
                    if len(u) > HELD_WORDS // 2:
                        model.letters.count(*letter_contexts(u), letters, n)
                        sets[kind] = words, letters, Tally()
        for kind, (words, letters, grams) in sets.items():
            u, n = grams.merged()
            model.letters.count(*letter_contexts(u), letters, n)
            tables = [*words, *letters]
            for t, table in enumerate(tables):
                for b in range(0, len(table), BLOCK):
                    block = table[b : b + BLOCK]
                    at = np.flatnonzero(block)
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([t + kind * len(tables)], pa.int32()), pa.array([b], pa.int32()), pa.array([_pack(at.astype(np.uint16), block[at])], pa.binary())], names=["t", "block", "counts"]
                        )

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for x in table["counts"].to_pylist():
            at, n = _unpack(x, np.uint16, U32)
            total[at] += n
        at = np.flatnonzero(total)
        total = np.minimum(total[at], 2**32 - 1).astype(U32)
        return pa.table({"t": table["t"].slice(0, 1), "block": table["block"].slice(0, 1), "counts": pa.array([_pack(at.astype(np.uint16), total)], pa.binary())})

    schema = "t int, block int, counts binary"
    return train.select("text", "half").mapInArrow(run, schema).groupBy("t", "block").applyInArrow(add, schema)


def read_tables(model: Model, counted: DataFrame) -> list[list[np.ndarray]]:
    """The tables of both halves, each for words and then letters; their size is bounded by MAX_BITS and LETTER_BITS."""
    sets = [[*model.words.empty(), *model.letters.empty()] for _ in range(2)]
    for r in counted.toLocalIterator():
        at, n = _unpack(r["counts"], np.uint16, U32)
        kind, t = divmod(r["t"], len(sets[0]))
        sets[kind][t][r["block"] + at.astype(np.int64)] = n
    return sets


def settle_tables(model: Model, tables: list[np.ndarray]) -> None:
    model.words.settle(tables[: len(model.words.sizes)])
    model.letters.settle(tables[len(model.words.sizes) :])


def count_inputs(train: DataFrame, shared: Broadcast) -> DataFrame:
    """(t, block, counts): bits of all training texts by their kind, of words and of letters, by blocks of kinds.

    shared: the model and both halves' coded tables; a text is looked up in those of the half that it isn't in.
    Its letters are those of its distinct words outside the frequent list, as they are where texts are scored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, tables = shared.value
        seen = np.zeros(math.prod(m.words.shape), np.int64)
        kinds_of_letters, grams = Tally(), (Tally(), Tally())

        def spelled(half: int) -> None:
            u, n = grams[half].merged()
            for a in range(0, len(u), 1 << 15):
                owner, kind = m.letters.kinds(*letter_contexts(u[a : a + (1 << 15)]), tables[1 - half][1])
                k, back = np.unique(kind, return_inverse=True)
                kinds_of_letters.add(k, np.bincount(back, n[a : a + (1 << 15)][owner]).astype(np.int64))
            kinds_of_letters.merged()
            grams[half].__init__()

        for part, buf, o in tx.chunks(batches, limit=CHUNK):
            w = tx.split_words(buf, o)
            tokens, kinds, first = with_ends(w)
            at = m.index.find(tokens)
            symbol = m.symbols(at, kinds)
            contexts = m.word_contexts(symbol, first)
            half = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(half)), np.diff(first))
            rare = np.flatnonzero(at < 0)
            rare = rare[tokens[rare] != END]
            one = rare[_pairs(doc[rare], tokens[rare])[2]]
            for k in np.unique(half).tolist():
                mine = np.flatnonzero(half[doc] == k)
                for a in range(0, len(mine), 1 << 12):
                    places = mine[a : a + (1 << 12)]
                    np.add.at(seen, m.words.kinds(symbol[places], [c[places] for c in contexts], tables[1 - k][0])[1], 1)
                places = one[half[doc[one]] == k]
                for a in range(0, len(places), 50_000):
                    i = places[a : a + 50_000] - doc[places[a : a + 50_000]]
                    grams[k].add(*np.unique(spell(buf, w.starts[i], w.ends[i])[0], return_counts=True))
                    if grams[k].fresh > HELD_WORDS // 2 and len(grams[k].merged()[0]) > HELD_WORDS // 2:
                        spelled(k)
        spelled(0)
        spelled(1)
        found = np.flatnonzero(seen)
        for t, (u, n) in enumerate(((found, seen[found]), kinds_of_letters.merged())):
            edges = np.append(np.flatnonzero(np.diff(u // INPUTS_BLOCK, prepend=-1)), len(u))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                blob = _pack((u[a:b] % INPUTS_BLOCK).astype(np.uint16), n[a:b])
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([int(u[a]) // INPUTS_BLOCK], pa.int32()), pa.array([blob], pa.binary())], names=["t", "block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(INPUTS_BLOCK, np.int64)
        for x in table["counts"].to_pylist():
            at, n = _unpack(x, np.uint16, np.int64)
            total[at] += n
        at = np.flatnonzero(total)
        return pa.table({"t": table["t"].slice(0, 1), "block": table["block"].slice(0, 1), "counts": pa.array([_pack(at.astype(np.uint16), total[at])], pa.binary())})

    schema = "t int, block int, counts binary"
    return train.select("text", "half").mapInArrow(run, schema).groupBy("t", "block").applyInArrow(add, schema)


def fit_mixers(model: Model, train: DataFrame, halves: list[list[np.ndarray]]) -> None:
    """Learn both mixers' weights and maps on all training texts; at most math.prod(shape) sums for each mixer reach the driver."""
    coded = []
    for tables in halves:
        settle_tables(model, tables)
        coded.append((model.words.coded(), model.letters.coded()))
    shared = train.sparkSession.sparkContext.broadcast((model, coded))  # of bounded size
    found = materialize(count_inputs(train, shared), "inputs")
    shared.destroy()
    sums = Tally(), Tally()
    for r in found.toLocalIterator():
        at, n = _unpack(r["counts"], np.uint16, np.int64)
        sums[r["t"]].add(at.astype(np.int64) + r["block"] * INPUTS_BLOCK, n)
    discard(found)
    for mixer, tally in zip((model.words, model.letters), sums, strict=True):
        mixer.fit(*tally.merged())


def train_model(docs: DataFrame, counted: DataFrame, held_out_fold: int, folds: int) -> Model:
    model = start_model(counted)
    half = F.coalesce(digest_mod("doc_id", 97), F.pmod(F.xxhash64("text"), F.lit(97))) % 2 == 1
    train = docs.where(F.coalesce(digest_mod("doc_id", folds) != held_out_fold, F.lit(True))).withColumn("half", half)
    found = materialize(count_contexts(train, model), "contexts")
    halves = read_tables(model, found)
    discard(found)
    fit_mixers(model, train, halves)
    settle_tables(model, [np.minimum(a.astype(np.int64) + b, 2**32 - 1).astype(U32) for a, b in zip(*halves, strict=True)])
    return model


# --- step 4 -----------------------------------------------------------------------------------------


def lm_scores(docs: DataFrame, held_out_fold: int = 1, folds: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each row."""
    spark = docs.sparkSession
    rows = id_and_text(docs).withColumn("held_out", F.coalesce(digest_mod("doc_id", folds) == held_out_fold, F.lit(False)))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = next_pow2(size / (16 << 20), 64)
    counted = materialize(count_words(rows.where("not held_out"), buckets, 8 * vocabulary_size(size // 4)), "words")
    model = train_model(rows, counted, held_out_fold, folds)
    shared = spark.sparkContext.broadcast(model)  # frequent words and tables, of bounded size
    shift = U64(64 - (buckets.bit_length() - 1))
    entries = "bucket int, source long, kind int, blob binary"
    unseen = np.log10(model.kinds[1])

    def flush(held: list, source: int) -> Iterator[pa.RecordBatch]:
        meta = [np.concatenate([x[i] for x in held]) for i in range(8)]
        h, row, tf, kind, spelled = (np.concatenate([x[i] for x in held]) for i in range(8, 13))
        order = np.argsort(h)
        h, row, tf, kind, spelled = h[order], row[order].astype(U32), tf[order].astype(U32), kind[order], spelled[order].astype(F32)
        cuts = np.searchsorted(h >> shift, np.arange(buckets + 1, dtype=U64))
        where, kinds, blobs = [source % buckets], [0], [_pack(*meta)]
        for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if y > x:
                where.append(b)
                kinds.append(1)
                blobs.append(_pack(h[x:y], row[x:y], tf[x:y], kind[x:y], spelled[x:y]))
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(np.full(len(where), source)), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "source", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m)
        logs, exact = np.log10(m.frequent_counts + 0.5), np.log10(m.frequent_counts)
        rest = np.log10(m.kinds.sum(axis=0))
        held: list = []
        n_rows = n_entries = 0
        source = TaskContext.get().partitionId() << 20
        for part, buf, o in tx.chunks(batches, limit=CHUNK):
            w = tx.split_words(buf, o)
            tokens, kinds, first = with_ends(w)
            docs_here = len(first) - 1
            doc = np.repeat(np.arange(docs_here), np.diff(first))
            at = m.index.find(tokens)
            score, symbol = scorer.score(at, kinds, first)
            known = at >= 0
            base = np.bincount(doc[known], logs[at[known]], docs_here).astype(float)  # whole numbers where nothing is known
            classed = symbol >= m.size
            inner = known & classed
            score = score + np.bincount(doc[inner], exact[at[inner]], docs_here) - np.bincount(doc[classed], rest[kinds[classed]], docs_here)
            count = np.bincount(doc[known], minlength=docs_here)
            lone = np.flatnonzero(~known)
            ends = lone[tokens[lone] == END]  # only a model without any training text doesn't know the end mark
            base += np.bincount(doc[ends], minlength=docs_here) * math.log10(0.5)
            lone = lone[tokens[lone] != END]
            pair, n, one = _pairs(doc[lone], tokens[lone])
            places = lone[one]
            spelled = scorer.spelled(w, places - doc[places])
            bytes_ = np.bincount(np.searchsorted(w.first, np.arange(len(w.starts)), "right") - 1, w.ends - w.starts, docs_here) + np.diff(first)
            ids = part.column(0)
            held.append(
                (
                    ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False), np.diff(first), count, base, score, bytes_,
                    pair[1], pair[0].astype(np.int64) + n_rows, n, kinds[places], spelled,
                )
            )
            n_rows, n_entries = n_rows + docs_here, n_entries + len(n)
            if n_entries >= HELD_WORDS or n_rows >= HELD_WORDS:
                yield from flush(held, source)
                held, n_rows, n_entries, source = [], 0, 0, source + 1
        if held:
            yield from flush(held, source)

    def meet(table: pa.Table) -> pa.Table:
        """In one hash range: sums over the entries of each row, with the counts of that range."""
        counts = [_unpack(b, U64, np.int64) for b, k in zip(table["blob"].to_pylist(), table["kind"].to_pylist(), strict=True) if k == 2]
        h, n = counts[0] if counts else (np.zeros(0, U64), np.zeros(0, np.int64))
        source, kind, blob = [], [], []
        for s, k, b in zip(table["source"].to_pylist(), table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True):
            if k == 0:
                source.append(s)
                kind.append(0)
                blob.append(b)
            elif k == 1:
                eh, row, tf, classes, spelled = _unpack(b, U64, U32, U32, np.uint8, F32)
                at = lookup(h, eh)
                c = np.where(at >= 0, n[np.maximum(at, 0)] if len(n) else 0, 0)
                u, back = np.unique(row, return_inverse=True)
                inner = np.where(c > 0, np.log10(np.maximum(c, 1)), unseen[classes])
                source.append(s)
                kind.append(1)
                sums = (tf * np.log10(c + 0.5), tf * inner, tf * (c > 0), tf * spelled * (c == 0))
                blob.append(_pack(u, *(np.bincount(back, x) for x in sums)))
        return pa.table({"source": pa.array(source, pa.int64()), "kind": pa.array(kind, pa.int32()), "blob": pa.array(blob, pa.binary())})

    total, distinct = model.total, model.distinct
    floor = math.log10(total + 0.5 * (distinct + 1))

    def finish(table: pa.Table) -> pa.Table:
        """For one source: its rows, with the sums that came back."""
        meta = next(b for b, k in zip(table["blob"].to_pylist(), table["kind"].to_pylist(), strict=True) if k == 0)
        ids, null, held_out, tokens, known, base, score, size = _unpack(meta, np.int64, bool, bool, np.int64, np.int64, np.float64, np.float64, np.float64)
        known, base, score = known.copy(), base.copy(), score.copy()
        spelled = np.zeros(len(ids))
        for b, k in zip(table["blob"].to_pylist(), table["kind"].to_pylist(), strict=True):
            if k == 1:
                u, logs, inner, n, letters = _unpack(b, U32, *[np.float64] * 4)
                base[u] += logs
                score[u] += inner
                known[u] += n.astype(np.int64)
                spelled[u] += letters
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=null),
                "held_out": pa.array(held_out),
                "n_tokens": pa.array(tokens),
                "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(len(ids), total)),
                "base_score": pa.array(base - tokens * floor),
                "score": pa.array(score),
                "bits_per_byte": pa.array(-(score + spelled) / math.log10(2) / np.maximum(size, 1)),
            }
        )

    sent = rows.select("doc_id", "text", "held_out").mapInArrow(run, entries)
    table = counted.select("bucket", F.lit(-1).cast("long").alias("source"), F.lit(2).alias("kind"), F.col("counts").alias("blob"))
    back = sent.union(table).groupBy("bucket").applyInArrow(meet, "source long, kind int, blob binary")
    return back.groupBy("source").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def _pairs(doc: np.ndarray, h: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs, how often each stands, and where it stands once."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    one = np.flatnonzero(new)
    return (d[one], x[one]), np.diff(np.append(one, len(d))), order[one]
