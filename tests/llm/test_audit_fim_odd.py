"""Operators 11 to 13 against brute force, with nulls, empties, ties, copies, repeated rows, long texts and clashing columns."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import audit, fim, oddsketch
from gneiss.llm import text as tx

SYLLABLES = "an the ti on ed re in er ing ou ha st é ß nt or".split()
SPACE = "\x20\x09-\x0d"


def prose(rng, n, capitals=0.0):
    words = ("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))
    return " ".join(w.upper() if rng.random() < capitals else w for w in words)


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text, source)"""
    rng = random.Random(11)
    base = [prose(rng, rng.choice([12, 80, 190, 230, 400]), rng.choice([0, 0, 0.2])) + rng.choice(["", "", " 5% off", " a | b"]) for _ in range(30)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    for i in range(40):
        t = base[i % 5].split(" ")
        for _ in range(rng.randint(0, len(t) // 12)):
            t[rng.randrange(len(t))] = "x" + str(rng.random())[2:6]
        rows.append((100 + i, " ".join(t), f"s{i % 4}"))
    rows += [(200 + i, base[7], "hot") for i in range(60)]
    odd = [None, "", " \n\t ", "one", "one", "ONE", "a b", "A  B", "the " * 900, "tail \n", " \x0b lead", "has <P> marker", "é ß x 😀 y", "<", "<P", "S> x"]
    rows += [(300 + i, t, None if i % 2 else "") for i, t in enumerate(odd)]
    rows += [(None, base[0], "s0"), (None, base[0], "s0"), (None, None, None), rows[0], rows[0], (5, base[6], "s9"), (400, prose(rng, 9000), "s1")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string, source string").repartition(5)
    return df.withColumns({c: F.lit("clash") for c in ("h", "salt", "n", "code", "ids", "part", "digest", "A", "E", "good", "spread", "words", "key", "bands", "sketch", "whole", "form", "x", "root", "bucket", "kept")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


# --- audit ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(0, 260, 2)] + [(4, 1, 0), (6, None, 1), (None, 1, 1), (9999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def plain_audit(corpus, labels):
    good, toxic, first = set(), set(), {}
    for i, q, t in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if t == 1 else set()
    for i, text, _ in corpus:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    marked = []
    for i, text, part in corpus:
        text = text or ""
        w = re.findall(f"[^{SPACE}]+", text)
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if i is not None and first[text] < i else set()
        marked.append((part or "", fails, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {m[0] for m in marked}:
        mine = [m for m in marked if m[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order):
                gone = [m for m in left if c in m[1]]
                left = [m for m in left if c not in m[1]]
                total[c] += len(gone)
                alone = sum(m[1] == {c} for m in mine)
                out[part, "".join(order), step + 1] = [len(left), len(gone), sum(c in m[1] for m in mine) - len(gone), alone, sum(m[2] for m in gone), sum(m[3] for m in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def test_audit_equals_running_the_filters(docs, labels, corpus):
    want = plain_audit(corpus, [tuple(r) for r in labels.collect()])
    rows = audit.filter_audit(docs, labels).collect()
    assert len(rows) == len(want) == 600 * len({c[2] or "" for c in corpus})
    for r in rows:
        assert list(r)[3:] == want[r["part"], r["filter_order"], r["step"]], r


def test_audit_of_nothing_and_of_other_rules(docs, empty, labels, corpus):
    assert audit.filter_audit(empty, labels).count() == 0
    none = labels.where("doc_id < 0")
    got = audit.filter_audit(docs, none, {"Z": lambda text, words: F.size(words) == 1}).collect()
    assert {(r["filter_order"], r["step"]) for r in got} == {("ZE", 1), ("ZE", 2), ("EZ", 1), ("EZ", 2)}
    assert sum(r["removed"] for r in got if r["filter_order"] == "ZE" and r["step"] == 1) == sum(len(re.findall(f"[^{SPACE}]+", t or "")) == 1 for _, t, _ in corpus)
    assert all(r["good_lost"] == r["toxic_lost"] == 0 for r in got)


# --- fill in the middle -----------------------------------------------------------------------------

TOKEN = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def plain_fim(i, text):
    text = text or ""
    d = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = TOKEN.findall(text)
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return i, len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return i, len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def order(rows):
    return sorted(rows, key=lambda r: tuple(str(x) for x in r))


def test_fim_equals_cutting_each_text(docs, empty, corpus):
    want = [plain_fim(i, t) for i, t, _ in corpus]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert order(tuple(r) for r in fim.fill_in_middle(docs).collect()) == order(want)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    digests = [(*w[:5], sha(w[5]), sha(t)) for w, (_, t, _) in zip(want, corpus, strict=True)]
    assert order(tuple(r) for r in fim.digests(docs).collect()) == order(digests)
    assert fim.digests(empty).count() == 0


def test_fim_always_cuts_and_restores(docs, corpus):
    got = fim.fill_in_middle(docs, seed=7, fim_rate=100)
    back = got.select("form", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t, _ in corpus)
    assert sum(r["form"] == "plain" for r in back) == sum(not t or bool(re.search("<[PSM]>", t)) for _, t, _ in corpus)


def test_index_holds_each_text_once_or_once_a_salt(spark, docs, corpus, monkeypatch):
    index = fim.text_index(docs).collect()
    assert sum(len(r["ids"]) for r in index) == len(corpus)
    copies = [r for r in index if r["text"] == corpus[7][1]]
    assert 1 <= len(copies) <= 5 and sum(len(r["ids"]) for r in copies) == 61
    assert len({r["text"] for r in index}) == len({t or "" for _, t, _ in corpus})
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(0).cast("long"))  # equal hashes don't make texts equal
    assert {r["text"] for r in fim.text_index(docs).collect()} == {t or "" for _, t, _ in corpus}


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (1, 10**9), (5, 5), (700, 10**4), (5000, 5000), (300, 10**12)):
        ends = np.unique(rng.integers(1, top + 1, n))
        code = fim.encode(ends)
        assert [fim.select(code, k) for k in range(len(ends))] == ends.tolist()
    assert len(fim.encode(np.cumsum(rng.integers(2, 12, 10**5)))) < 0.7 * 10**5  # under six bits a token


def test_token_ends_of_a_long_text(monkeypatch):
    rng = random.Random(5)
    text = prose(rng, 3000) + " \n"
    want = np.cumsum([len(x) for x in TOKEN.findall(text)])
    for size in (7, 64, 4 << 20):
        monkeypatch.setattr(tx, "PIECE_BYTES", size)
        assert (fim.token_ends(np.frombuffer(text.encode(), np.uint8)) == want).all()


# --- odd sketches -----------------------------------------------------------------------------------


def shingles(text, k=2):
    w = re.findall(f"[^{SPACE}]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain_near(corpus):
    sets = [shingles(t) for _, t, _ in corpus]
    part = list(range(len(corpus)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                part[root(i)] = root(j)
    least = {}
    for i, (d, _, _) in enumerate(corpus):
        if d is not None and sets[i]:
            least[root(i)] = min(d, least.get(root(i), d))
    out = []
    for i, (d, _, _) in enumerate(corpus):
        c = None if d is None else least[root(i)] if sets[i] else d
        out.append((d, len(sets[i]), c, None if d is None else c == d))
    return out


def test_near_duplicates_equal_all_pairs(docs, empty, corpus):
    want = plain_near(corpus)
    assert len({c for d, _, c, _ in want if d is not None and c != d}) >= 5
    assert order(tuple(r) for r in oddsketch.near_duplicates(docs).collect()) == order(want)
    assert oddsketch.near_duplicates(empty).count() == 0


def test_near_duplicates_by_the_last_round_and_in_many_salts(docs, corpus, monkeypatch):
    monkeypatch.setattr(oddsketch, "PER_SALT", 2)
    monkeypatch.setattr(oddsketch, "FEW_KEYS", 0)
    monkeypatch.setattr(oddsketch, "LEADER_ROUNDS", 1)
    monkeypatch.setattr(oddsketch, "likely", lambda pairs, sets, most: pairs.limit(0))  # leaders link nothing
    assert order(tuple(r) for r in oddsketch.near_duplicates(docs).collect()) == order(plain_near(corpus))


def pairs_at(rng, n, similar, count):
    """Hash sets a and b of n shingles each whose similarity is just at or above `similar`."""
    both = -(-int(round(2 * n * similar * 1000)) // int(round((1 + similar) * 1000)))
    for _ in range(count):
        h = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        yield np.sort(h[:n]), np.sort(h[n - both :])


def test_sketches_lose_no_pair_and_drop_the_unlike():
    rng = np.random.default_rng(17)
    most = oddsketch.most_odd_bits()
    limit = lambda n: min(2 * n / 9, oddsketch.WHOLE_BITS / 2 * (1 - np.exp(-4 * n / 9 / oddsketch.WHOLE_BITS)) + 5.5 * np.sqrt(oddsketch.WHOLE_BITS / 4 * (1 - np.exp(-8 * n / 9 / oddsketch.WHOLE_BITS))) + 2)
    passed = {}
    for similar in (0.8, 0.6):
        for n in (5, 30, 150, 3000):
            met = kept = 0
            for a, b in pairs_at(rng, n, similar, 150):
                h, o = np.concatenate((a, b)), np.array([0, n, 2 * n])
                mins = oddsketch.min_hashes(h, o[:-1])
                bands, odd, whole = oddsketch.band_hashes(mins), oddsketch.odd_sketches(mins), oddsketch.whole_sketches(h, o)
                met += bool((bands[0] == bands[1]).any())
                kept += int(np.bitwise_count((odd[0] ^ odd[1]).view(np.uint64)).sum()) <= most and int(np.bitwise_count((whole[0] ^ whole[1]).view(np.uint64)).sum()) <= limit(n)
            passed[similar, n] = (met, kept)
    assert all(passed[0.8, n] == (150, 150) for n in (5, 30, 150, 3000)), passed
    assert passed[0.6, 150][1] <= 2 and passed[0.6, 3000][1] <= 60, passed


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(23)
    for similar in (0.8, 0.9, 0.95):
        found = []
        for a, b in pairs_at(rng, 400, similar, 60):
            odd = oddsketch.odd_sketches(oddsketch.min_hashes(np.concatenate((a, b)), np.array([0, 400])))
            z = int(np.bitwise_count((odd[0] ^ odd[1]).view(np.uint64)).sum())
            found.append(1 + oddsketch.BITS / (4 * oddsketch.SAMPLES) * np.log(1 - 2 * z / oddsketch.BITS))
        assert abs(np.mean(found) - similar) < 0.015, (similar, np.mean(found))
