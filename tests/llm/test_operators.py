"""Each operator against a brute-force version on small tables with nulls, empties, ties, copies and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gneiss.llm import components, decontam, html, jaccard, licences, lm, packing, quality, rules, sentences, suffixes
from gneiss.llm import text as tx

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SYLLABLES = "an the ti on ed re in er ing ou ha st é ß nt or".split()


def words(text):
    return [w.translate(FOLD) for w in WORD.findall((text or "").encode())]


def prose(rng, n):
    out = []
    for i in range(n):
        w = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
        out.append(w + (rng.choice([".", ".", ".\n"]) if i % 9 == 8 else ""))
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text) with nulls, empties, exact and near copies, shared passages, repeated rows and a long text."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(24)]
    passage = prose(rng, 70)
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40):
        t = base[i % 6].split(" ")
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = "x" + str(rng.random())
        rows.append((100 + i, " ".join(t)))
    rows += [(200 + i, prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 20)) for i in range(6)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "one"), (305, "a b c"), (306, "A b  c"), (307, "the " * 900), (308, prose(rng, 6000)), (None, base[0])]
    rows += [rows[0], rows[0]]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    # clashing names of the operators' own columns
    return df.withColumns({c: F.lit("clash") for c in ("rid", "key", "n", "token", "root", "words", "lines", "score", "spans", "cuts", "held_out", "source", "turn")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def collected(df):
    return [r.asDict() for r in df.collect()]


# --- packing ----------------------------------------------------------------------------------------


def fewest(sizes, capacity):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] >= sizes[i] and bins[j] not in bins[:j]:
                go(i + 1, bins[:j] + [bins[j] - sizes[i]] + bins[j + 1 :])
        go(i + 1, [*bins, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_plan_packs_everything_as_well_as_search():
    rng = np.random.default_rng(3)
    worse = 0
    for _ in range(120):
        capacity = int(rng.choice([10, 17, 24]))
        sizes = sorted(rng.integers(1, capacity + 1, int(rng.integers(1, 9))).tolist(), reverse=True)
        classes = packing.plan_classes(Counter(sizes), capacity)
        used = Counter()
        for many, items in classes:
            assert sum(s * k for s, k in items) <= capacity
            for s, k in items:
                used[s] += many * k
        assert used == Counter(sizes)
        worse += sum(m for m, _ in classes) > fewest(sizes, capacity)
    assert worse <= 2
    assert sum(m for m, _ in packing.plan_classes({3: 10**9, 7: 10**9}, 10)) == 10**9


def test_dominating_sets():
    count = np.zeros(11, np.int64)
    count[[7, 3, 2]] = 1
    assert packing.dominating_set(count, 7, 10) == [7, 3]
    count[3] = 0
    assert packing.dominating_set(count, 7, 10) == [7, 2]
    assert packing.dominating_set(count, 10 - 0 if count[10] else 7, 8) == [7]


def test_token_ids_are_the_tokenizers():
    t = Tokenizer.from_file(TOKENIZER)
    texts = ["Don't stop, it's 12'S!! X'RE", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "é́ á. ≠ İ x\x85y", "", "tab\tand\nline", "ﬁne 你好 🙂!"]
    encoder = packing.PartEncoder(TOKENIZER)
    buf, o = tx.buffers(pa.array(texts))
    assert [x.tolist() for x in encoder.encode(buf, o)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    long = prose(random.Random(5), 400_000) * 4
    buf, o = tx.buffers(pa.array([long]))
    assert len(buf) > 2 * tx.PIECE_BYTES and encoder.encode(buf, o)[0].tolist() == t.encode(long, add_special_tokens=False).ids


def test_packing(spark, docs, corpus, empty):
    t = Tokenizer.from_file(TOKENIZER)
    out = packing.pack(docs, TOKENIZER, 128).toPandas()
    want = Counter()
    for i, x in corpus:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 128)):
            part = np.array(ids[a : a + 128], "<u4")
            want[(i, k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    got = Counter(tuple(None if v != v else v for v in r) for r in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    assert {tuple(-1 if v is None else int(v) for v in k): n for k, n in got.items()} == {tuple(-1 if v is None else v for v in k): n for k, n in want.items()}
    out = out.sort_values(["sequence_id", "offset"])
    assert (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all() and out.groupby("sequence_id").length.sum().max() <= 128
    assert packing.pack(empty, TOKENIZER).count() == 0


# --- decontamination --------------------------------------------------------------------------------


def test_decontamination(spark, docs, corpus):
    rng = random.Random(11)
    items = [(1, " ".join(corpus[3][1].split()[5:30])), (2, prose(rng, 30)), (3, None), (4, ""), (5, "one"), (6, "A b c"), (7, " ".join(corpus[4][1].split()[4:34]) + " tail")]
    items.append(items[0])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in collected(decontam.contaminated(docs, bench))}
    want = set()
    for i, text in corpus:
        w = words(text)
        for item, target in items:
            b = words(target)
            if not b or not w:
                continue
            k = min(5, len(b))
            grams = lambda x, k=k: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
            cb, m = grams(b), min(len(b), len(w))
            for a in range(len(w) - m + 1):
                cw = grams(w[a : a + m])
                less = sum((cw & cb).values())
                if less and 100 * less >= 80 * (sum(cw.values()) + sum(cb.values()) - less):
                    want.add((i, item))
                    break
    assert got == want and (303, 5) in got
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    gone = {i for i, _ in want}
    assert sorted(r["doc_id"] or -1 for r in collected(kept)) == sorted(i or -1 for i, _ in corpus if i not in gone)
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_overlaps_of_all_windows():
    rng = np.random.default_rng(4)
    for _ in range(300):
        g = rng.integers(0, 6, int(rng.integers(3, 40))).astype(np.uint64)
        n = int(rng.integers(1, len(g) + 1))
        item = np.sort(rng.integers(0, 8, int(rng.integers(1, 20))).astype(np.uint64))
        want = [sum((Counter(g[a : a + n].tolist()) & Counter(item.tolist())).values()) for a in range(len(g) - n + 1)]
        assert decontam.overlaps(g, n, item).tolist() == want


def test_decontamination_of_repetitive_and_long_texts(spark):
    rng = random.Random(3)
    hidden = prose(rng, 40)
    rows = [(1, "the " * 200_000), (2, "x " * 5_000_000 + hidden + " y" * 1_000_000), (3, "the " * 1000)]
    bench = spark.createDataFrame([(7, "the " * 2000), (8, hidden), (9, "the the of " * 700)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in collected(decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench))}
    assert set(found) == {(1, 7), (2, 8)}
    assert (found[2, 8]["first_word"], found[2, 8]["n_words"], found[2, 8]["similarity"]) == (5_000_000, 40, 1.0)


def test_many_items_take_several_passes(spark, docs, corpus, monkeypatch):
    items = [(i, " ".join(corpus[i % 24][1].split()[i : i + 20])) for i in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted((r["doc_id"] or -1, r["item_id"], r["first_word"], r["similarity"]) for r in collected(df))
    want = key(decontam.contaminated(docs, bench))
    assert want
    monkeypatch.setattr(decontam, "ITEMS_PER_BLOCK", 2)
    monkeypatch.setattr(decontam, "BLOCKS_PER_PASS", 2)
    assert key(decontam.contaminated(docs, bench)) == want


def test_recall_of_the_radius():
    """Of windows just at similarity 0.8 or above, almost none has a fingerprint outside the radius."""
    rng = np.random.default_rng(1)
    seen = found = 0
    for words_of_item in (6, 12, 30, 80, 200):
        for _ in range(400):
            item = rng.integers(1, 2**63, words_of_item, dtype=np.uint64)
            copy = item.copy()
            for _ in range(int(rng.integers(1, max(2, words_of_item // 30)))):
                copy[rng.integers(0, words_of_item) if rng.random() < 0.7 else 0] = rng.integers(1, 2**63)
            x, y = tx.grams(item, 5), tx.grams(copy, 5)
            less = int(decontam.overlaps(y, len(y), np.sort(x))[0])
            if 100 * less >= 80 * (len(x) + len(y) - less):
                seen += 1
                a, b = (decontam.fingerprints(decontam.bit_votes(v)[-1:])[0] for v in (x, y))
                found += int(np.bitwise_count(a ^ b)) <= decontam.RADIUS
    assert seen > 300 and found >= 0.995 * seen


def test_words_of_a_long_text():
    rng = random.Random(1)
    raw = np.frombuffer((prose(rng, 300) + " " + "z" * (9 << 20) + " " + "ab cd\n" * (2 << 20)).encode(), np.uint8)
    o = np.array([0, len(raw)])
    a, b = tx.split_words(raw, o), tx._words(raw, o, True)
    assert (a.starts == b.starts).all() and (a.ends == b.ends).all() and (a.hashes == b.hashes).all() and a.first.tolist() == b.first.tolist()


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(0)
    items = decontam.Items(list(range(30)), [prose(random.Random(i), 12) for i in range(30)])
    prints = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = items.prints[rng.integers(0, 30, 400)]
    for _ in range(18):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    for p in (prints, near):
        i, j = items.near(p, 12)
        want = {(a, b) for a in range(len(p)) for b in range(30) if int(np.bitwise_count(p[a] ^ items.prints[b])) <= decontam.RADIUS}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


# --- quality, rules, licences -----------------------------------------------------------------------


def test_quality(spark, docs, empty):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60) if i % 3 else " ".join(w + "%%%" for w in prose(rng, 60).split())) for i in range(240)] + [(1000, None), (None, "x"), (1001, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(5, None), (None, 1), (1, 1)], "doc_id long, quality int")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = quality.quality_scores(table, labels).toPandas()
    held = out[out.held_out & out.doc_id.notna() & (out.doc_id < 240)]
    assert len(out) == len(rows) and len(held) > 20
    assert ((held.score >= 0.3).astype(int) == held.predicted).all() and (held.predicted == (held.doc_id % 3 > 0)).mean() > 0.95
    assert all((zlib.crc32(str(int(i)).encode()) % 5 == 0) == h for i, h in zip(out.doc_id.dropna(), out[out.doc_id.notna()].held_out, strict=True))
    assert quality.quality_scores(docs, labels.limit(0)).where("score != 0.5").count() == 0
    assert quality.quality_scores(empty, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_rules(docs, corpus, empty):
    got = collected(rules.quality_rules(docs))
    assert len(got) == len(corpus)
    by = {r["doc_id"]: r for r in got}
    for i, text in corpus:
        w = [x.decode() for x in WORD.findall((text or "").encode())]
        windows = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {p for j in range(len(w) - 4) if windows[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x.encode())]
        r = by[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert rules.quality_rules(empty).count() == 0
    assert rules.quality_rules(docs).where("kept").count() == sum(r["kept"] for r in got)
    assert rules.clean_lines(docs).count() > 0


def test_licences(spark, docs, empty):
    rng = random.Random(4)
    rows = [(i, prose(rng, 40)) for i in range(60)] + [(100, prose(rng, 20) + "\nReleased under the MIT License.\n" + prose(rng, 9)), (101, "Licensed under CC BY-NC 4.0."), (102, None), (103, "")]
    got = {r["doc_id"]: r["licences"] for r in collected(licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), 300))}
    assert got[100] == ["mit"] and got[101] == ["cc-by-nc"] and got[102] == got[103] == []
    assert sum(bool(v) for v in got.values()) == 2
    wrapped = {
        1: ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal\nin the Software without restriction"),
        2: ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"),
        3: ("gpl", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by"),
    }
    rows += [(200 + k, prose(rng, 30) + "\n" + text + "\n" + prose(rng, 20)) for k, (_, text) in wrapped.items()] + [(210, prose(rng, 20) + "\nLicensed under the MIT license or licensed under the BSD 3-Clause License.\n" + prose(rng, 9))]
    got = {r["doc_id"]: r["licences"] for r in collected(licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), 300))}
    assert [got[200 + k] for k in wrapped] == [[f] for f, _ in wrapped.values()] and got[210] == ["bsd", "mit"]
    assert sum(bool(v) for v in got.values()) == 6
    assert licences.scan_licences(empty).count() == 0
    assert licences.scan_licences(docs, 100).count() == docs.count()


# --- near duplicates --------------------------------------------------------------------------------


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard(docs, corpus, empty):
    sets = {}
    for i, t in corpus:
        sets.setdefault(i, shingles(t))
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    got = [r for r in collected(jaccard.jaccard_components(docs)) if r["doc_id"] is not None]
    assert len(got) == len(corpus) - 1
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, len(sets[i]), root[i]) for i in ids}
    kept = [r["doc_id"] for r in collected(jaccard.keep_one(docs))]
    assert sorted({i for i in kept if i is not None}) == sorted(i for i in ids if root[i] == i)
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_in_salts(spark, monkeypatch):
    """Texts made of few sentences, so that all shingles are frequent; nearly all links are left to the last round."""
    monkeypatch.setattr(jaccard, "LEADER_ROUNDS", 1)
    monkeypatch.setattr(jaccard, "LEADERS", 1)
    monkeypatch.setattr(jaccard, "PER_SALT", 3)
    rng = random.Random(21)
    sentences = [prose(rng, rng.choice((6, 12, 25))) for _ in range(14)]
    rows = []
    for i in range(90):
        picked = rng.sample(sentences, rng.randrange(4, 12))
        rows.append((i, " ".join(picked)))
        if i % 3 == 0:
            rows.append((1000 + i, " ".join(picked[:-1])))
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    last, plain = [], jaccard.unlinked_pairs
    monkeypatch.setattr(jaccard, "unlinked_pairs", lambda left: last.append((left.agg(F.max("salts")).first()[0], plain(left).count())) or plain(left))
    got = collected(jaccard.jaccard_components(docs))
    assert last[0][0] > 1 and last[0][1] > 0
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, len(sets[i]), root[i]) for i in sets}
    assert 10 < len(set(root.values())) < len(sets) - 10


def test_keep_one_keeps_one_row_of_each_group(spark):
    rng = random.Random(5)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(1, a), (1, a), (2, a), (None, a), (3, b), (3, b), (None, c), (None, c), (2, d), (9, d + " end"), (4, ""), (4, ""), (5, None), (6, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("source", F.lit("x"))
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in collected(kept)) == Counter([(1, a), (3, b), (None, c), (2, d), (4, ""), (5, None), (6, " ")])


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 3), (7, 7)]
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            x, y = root.setdefault(a, a), root.setdefault(b, b)
            root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in collected(got)} == root
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- repeated text ----------------------------------------------------------------------------------


def test_sentences(docs, corpus, empty):
    got = collected(sentences.repeated_sentences(docs))
    assert len(got) == len(corpus)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    texts = dict(corpus)
    assert by[200][0]["n_removed"] == 0 and all(by[i][0]["n_removed"] > 0 for i in range(201, 206))
    assert all(r["n_removed"] == 0 for r in by[0]) and by[300][0]["text"] is None
    for i in range(201, 206):
        assert words(by[i][0]["text"]) == words(texts[i].split("\n" + texts[200].split("\n")[0])[0])[: len(words(by[i][0]["text"]))] or len(words(by[i][0]["text"])) < len(words(texts[i]))
    assert sentences.repeated_sentences(empty).count() == 0


def repeats(raws, length):
    """Of each text, whether each byte is covered by a string of `length` bytes that also starts elsewhere."""
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 2, bool)
        for a in range(len(r) - length + 1):
            if count[r[a : a + length]] > 1:
                gone[a + 1 : a + 1 + length] = True
        out.append(gone)
    return out


def test_suffixes(docs, corpus, empty):
    length, short = 80, 50
    raws = [(t or "").encode() for _, t in corpus]
    want = Counter()
    for (i, _), r, gone, less in zip(corpus, raws, repeats(raws, length), repeats(raws, short), strict=True):
        kept = np.frombuffer(r, np.uint8)[~gone[1:-1]].tobytes()
        want[(i, len(r), len(r) - len(kept), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest(), int(less.sum()))] += 1
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_repeated_short"]) for r in collected(suffixes.removal_digest(docs, length, short)))
    assert got == want
    assert suffixes.removal_digest(empty).count() == 0
    kept = suffixes.remove_repeats(docs.withColumn("k", F.lit("clash")).withColumn("row", F.lit("clash")), length)
    assert kept.columns == [*docs.columns, "k", "row"] and kept.where("k = 'clash' and row = 'clash'").count() == len(corpus)
    want = Counter((i, None if t is None else np.frombuffer(r, np.uint8)[~gone[1:-1]].tobytes().decode("utf-8", "ignore")) for (i, t), r, gone in zip(corpus, raws, repeats(raws, length), strict=True))
    assert Counter((r["doc_id"], r["text"]) for r in collected(kept)) == want


def test_suffixes_of_a_text_read_in_pieces(spark):
    rng = np.random.default_rng(2)
    letters = rng.integers(97, 123, tx.PIECE_BYTES * 2 + 5000, dtype=np.uint8).tobytes().decode()
    edge = tx.PIECE_BYTES
    rows = [(1, letters), (2, "x" * 50 + letters[edge - 250 : edge + 300] + "y" * 50), (3, letters[2 * edge - 10 : 2 * edge + 195]), (4, letters[5000:5400])]
    got = {r["doc_id"]: (r["n_removed"], r["n_repeated_short"], r["n_spans"]) for r in collected(suffixes.removal_digest(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == {1: (950, 550 + 205 + 400, 2), 2: (550, 550, 1), 3: (0, 205, 0), 4: (400, 400, 1)}


def test_suffixes_across_range_ends(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "RANGE_BYTES", 500)
    rng = random.Random(1)
    passage = "".join(rng.choice("abcd ") for _ in range(70))
    rows = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 50))) + passage[: rng.randint(40, 70)] + "".join(rng.choice("xyz") for _ in range(20))) for i in range(80)]
    length = 40
    raws = [t.encode() for _, t in rows]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    want = {}
    for (i, _), r in zip(rows, raws, strict=True):
        gone = {p for a in range(len(r) - length + 1) if count[r[a : a + length]] > 1 for p in range(a, a + length)}
        want[i] = len(gone)
    got = {r["doc_id"]: r["n_removed"] for r in collected(suffixes.removal_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), length))}
    assert got == want


def test_suffixes_of_split_tables(spark, monkeypatch):
    """Copies count wherever a context's bytes are: several row groups, read by several tasks, and several runs of a task."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(60, 200))) for _ in range(150)]
    rows = [(i, base[i % 150]) for i in range(300)]
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def removed():
        return {r["doc_id"]: r["n_removed"] for r in collected(suffixes.removal_digest(df, 40))}

    want = {i: len(t) for i, t in rows}
    assert removed() == want
    monkeypatch.setattr(suffixes, "RUN_BYTES", 1000, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    hadoop.setInt("parquet.block.size", 4096)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        assert removed() == want
    finally:
        hadoop.unset("parquet.block.size")
        for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(name)


def test_loser_tree():
    rng = random.Random(3)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 30))) for _ in range(7)]
    coded = [suffixes.front_code(r) for r in runs]
    assert [suffixes.front_decode(s, rest, m) for s, rest, m in coded] == runs
    order = list(suffixes.LoserTree([(r, c[0].tolist()) for r, c in zip(runs, coded, strict=True)]))
    out = [runs[r][i] for r, i, _ in order]
    assert out == sorted(x for r in runs for x in r)
    for (x, y), (_, _, lcp) in zip(zip(out, out[1:], strict=False), order[1:], strict=True):
        assert lcp == suffixes.common_prefix(x, y)


# --- language model ---------------------------------------------------------------------------------


def test_lm(docs, corpus, empty):
    out = lm.lm_scores(docs).toPandas()
    assert len(out) == len(corpus)
    train = Counter()
    for i, t in corpus:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            train.update([*words(t), None])
    total, floor = sum(train.values()), np.log10(sum(train.values()) + 0.5 * (len(train) + 1))
    by = {r.doc_id: r for r in out[out.doc_id.notna()].itertuples()}
    for i, t in corpus:
        if i is not None:
            w = [*words(t), None]
            assert (by[i].n_tokens, by[i].n_known, by[i].train_tokens) == (len(w), sum(train[x] > 0 for x in w), total)
            assert by[i].base_score == pytest.approx(sum(np.log10(train[x] + 0.5) - floor for x in w))
            assert by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 1) and by[i].score < 0 and by[i].bits_per_byte > 0
    assert lm.lm_scores(empty).count() == 0


def test_symbol_probabilities_sum_to_one():
    m = lm.Mixer(np.array([5, 3, 1, 1, 0]), (7, 8))
    counts = m.empty()
    symbols = np.array([0, 1, 0, 2, 3, 0, 4])
    contexts = [np.arange(7, dtype=np.uint32), np.arange(7, dtype=np.uint32) * np.uint32(7)]
    m.count(symbols, contexts, counts)
    m.settle(counts)
    m.learn(symbols, contexts)
    one = [np.full(5, 3, np.uint32), np.full(5, 9, np.uint32)]
    assert (10 ** m.cost(np.arange(5), one)).sum() == pytest.approx(1, abs=1e-3)


def test_each_text_follows_its_own_words(monkeypatch):
    """Texts scored together get what a plain loop over each alone gives, and following a text does better than not."""
    rng = np.random.default_rng(6)
    m = lm.Mixer(np.array([50, 30, 9, 8, 3, 1]), (9, 9))
    texts = [rng.choice(6, int(n), p=[0.02, 0.02, 0.06, 0.1, 0.3, 0.5]) for n in (900, 0, 1, 350, lm.STEP, lm.STEP + 1)]
    symbols, first = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    contexts = [rng.integers(0, 4, len(symbols)).astype(np.uint32) for _ in range(2)]
    counts = m.empty()
    m.count(rng.choice(6, 3000, p=[0.5, 0.3, 0.1, 0.05, 0.03, 0.02]), [rng.integers(0, 4, 3000).astype(np.uint32) for _ in range(2)], counts)
    m.settle(counts)
    together = m.follow(symbols, contexts, first)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        own, want = np.zeros(3), 0.0
        logs, ones = m.final_map()
        for lo in range(a, b, lm.STEP):
            part = slice(lo, min(lo + lm.STEP, b))
            owner, at = m.path(symbols[part])
            gradient, bits = np.zeros(3), len(at)
            logits, gate = m.inputs(owner, at, [c[part] for c in contexts])
            for k in range(bits):
                x = np.array([float(v[k]) for v in logits])
                z = float(np.float32(x @ m.weights[gate[k]] + x @ own))
                place = int(np.clip(z * lm.FINE + 12 * lm.FINE + 0.5, 0, 24 * lm.FINE)) + m.depth[at[k]] * (24 * lm.FINE + 1)
                y = m.bits[at[k]]
                want += logs[y, place]
                gradient += (y - ones[place]) * x
            own = np.clip(own + lm.RATE / 8 * gradient / (bits + 64), -1, 1)
        assert together[i] == pytest.approx(want, rel=2e-3, abs=1e-6)
    assert together[0] > m.follow(symbols, contexts, first, 0.0)[0]


def test_weights_learn_from_every_training_text(spark, corpus, monkeypatch):
    """No id of these is in the fold that alone was learned from once; every bit of every training text counts, and never by tables that hold its text."""
    learned = []
    fit = lm.Mixer.fit
    monkeypatch.setattr(lm.Mixer, "fit", lambda self, kinds, n: (learned.append((self.shape, self.codes, kinds, n)), fit(self, kinds, n))[1])

    def train(rows):
        learned.clear()
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        return lm.train_model(df, lm.count_words(df, 64, 2048), 1, 5)

    def digest(i):
        return zlib.crc32(str(i).encode())

    rows = [(i, t) for i, (_, t) in zip((i for i in range(1000) if digest(i) % 97 != 3 and digest(i) % 5 != 1), corpus, strict=False)] + [(None, "one more")]
    model = train(rows)
    assert not np.allclose(model.words.weights, 1 / 3, atol=0.01) and not np.allclose(model.letters.weights, 1 / 4, atol=0.01)
    column = pa.array([t for _, t in rows], pa.string())
    w = tx.split_words(*tx.buffers(column))
    tokens, kinds, _ = lm.with_ends(w)
    assert learned[0][3].sum() == model.words.length[model.symbols(model.index.find(tokens), kinds)].sum()
    rare = [x for t in column.to_pylist() for x in {*words(t)} if model.index.find(tx.split_words(np.frombuffer(x, np.uint8), np.array([0, len(x)])).hashes)[0] < 0]
    assert learned[1][3].sum() == sum(model.letters.length[[*x, 256]].sum() for x in rare)
    one_half = [(i, t) for i, t in zip((i for i in range(1000) if digest(i) % 97 % 2 == 0 and digest(i) % 5 != 1), (t for _, t in corpus), strict=False)]
    train(one_half)  # the other half's tables are empty
    for shape, codes, kinds, _ in learned:
        for c, places in zip(codes, np.unravel_index(kinds, shape)[3:], strict=True):
            assert not c.logits[places].any() and not c.levels[places].any()


def test_best_weights_and_map():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 2, (4000, 3))
    n = rng.integers(1, 50, 4000)
    y = (rng.random(4000) < lm.squash(x @ [0.1, 0.9, 0.4])).astype(float)
    w = lm.best_weights(x, y, n)
    assert np.abs(x.T @ (n * (lm.squash(x @ w) - y)) + lm.PRIOR * (w - 1 / 3)).max() < 1e-3
    assert np.abs(w - [0.1, 0.9, 0.4]).max() < 0.15
    apart = lm.best_weights(np.array([[9.0, 1.0], [-9.0, 1.0]]), np.array([1.0, 0.0]), np.array([1e12, 1e12]))
    assert np.isfinite(apart).all()
    m = lm.Mixer(np.array([5, 3, 1, 1, 0]), (7, 8))
    counts = m.empty()
    symbols, contexts = rng.choice(5, 9000, p=[0.5, 0.2, 0.1, 0.1, 0.1]), [rng.integers(0, 4, 9000).astype(np.uint32) for _ in range(2)]
    m.count(symbols, contexts, counts)
    m.settle(counts)
    owner, kind = m.kinds(symbols, contexts, m.coded())
    _, at = m.path(symbols)
    logits, gate = m.inputs(owner, at, contexts)
    depth, y, own, *places = np.unravel_index(kind, m.shape)
    assert (depth == m.depth[at]).all() and (y == m.bits[at]).all() and np.abs(m.own_logits[own] - logits[0]).max() < 1e-5
    assert all(np.abs(c.logits[i] - v).max() <= lm.LOGIT_STEP / 2 + 1e-6 for c, i, v in zip(m.codes, places, logits[1:], strict=True))
    assert (m.codes[0].levels[places[0]] * lm.LEVELS + m.codes[1].levels[places[1]] == gate).all()
    before = m.cost(symbols, contexts).sum()
    m.learn(symbols, contexts)
    assert m.cost(symbols, contexts).sum() > before


# --- pages ------------------------------------------------------------------------------------------


def test_html(spark):
    def page(i, extra=""):
        return f"<html><head><title>t{i}</title><script>var a='</p>';</script></head><body><div class=top><a href=/>Home</a> <a href=/x>About</a></div><div id=c><h2>Head {i}</h2><p>Text {i} &amp; more<br>of\n it {extra}<p>Second {i * i} <b>bold</b>.</div><div class=n>Sold by the same shop</div><footer>f</footer>"

    rows = [(i, f"http://a.example/{i}", page(i, "word " * i)) for i in range(12)] + [
        (100, "http://b.example/1", "<article><h1>One</h1><p>a&lt;b <i>c</i>d<div class=comments><p>no</p></div><form>x</form></article><aside>s</aside>"),
        (101, None, None),
        (102, "nonsense", ""),
        (103, "http://a.example/z", "<p <<>> </b></div> text"),
    ]
    rows.append(rows[0])
    got = {r["page_id"]: r for r in collected(html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))))}
    assert got[3]["text"] == "Head 3 Text 3 & more of it word word word Second 9 bold."
    assert got[100]["text"] == "One a<b cd" and got[100]["n_chars"] == 10
    assert got[101]["text"] == got[102]["text"] == "" and "text" in got[103]["text"]
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def host_page(rng, i, kind):
    """(page, its article) of a made-up host: no element or class says what the article is; parts are optional, repeated and in turn."""
    text = lambda n: " ".join(prose(rng, n).split())
    sections = [(text(4), [text(rng.randint(15, 40)) for _ in range(rng.randint(1, 3))]) for _ in range(rng.randint(1, 4))]
    inner = "".join(f"<h2>{h}</h2>" + "".join(f"<p>{t[:20]}<b>{t[20:]}</b>" + "</p>" * (i % 2) for t in ts) for h, ts in sections)
    links = "".join(f"<li><a href=/{k}>{text(2)}</a></li>" for k in range(rng.randint(2, 9)))
    promo = f"<div class=x3>{text(5)}</div>" if rng.random() < 0.5 else ""
    title = text(6)
    shell = {
        "a": f"<body><div class=x1><ul>{links}</ul></div>{promo}<div class=x2><h1>{title}</h1><div class=x4>{inner}</div><div class=x5>Sold by the same shop</div></div><div class=x6>{text(3)}</div>",
        "b": f"<body><table><tr><td class=y1>{links}</td><td class=y2><div class=y3>{inner}</div></td></tr></table>{promo}",
    }[kind]
    return f"<html><head><title>{text(3)}</title></head>{shell}</body></html>", " ".join([title] * (kind == "a") + [x for h, ts in sections for x in (h, *ts)])


def test_wrappers_find_unnamed_articles(spark):
    rng = random.Random(8)
    made = [(i, f"http://{'ab'[i % 2] if i % 3 else 'mixed'}.example/{i}", *host_page(rng, i, "ab"[i % 2])) for i in range(120)]
    df = spark.createDataFrame([x[:3] for x in made], "page_id long, url string, html string").repartition(7)
    for names in (True, False):
        got = {r["page_id"]: r["text"] for r in collected(html.main_text(df, names))}
        assert got == {i: article for i, _, _, article in made}
    assert sum(html.extract(page) == article for _, _, page, article in made) == 0  # without its wrapper no page says where the article is


def test_expression_of_repeats_and_options():
    pages = [f"<ul>{'<li>x' * n}</ul><div class=a>t{n}</div>" + "<h2>h<p>p" * (n % 3) + ("<hr><i>tail</i>" if n > 2 else "") for n in range(1, 7)]
    whole = html.fold_pages(pages, False)
    assert [(k.sig, k.optional, k.repeated) for k in whole.kids] == [("ul", False, False), ("div.a", False, False), ("h2", True, True), ("hr", True, False), (html.TEXT, True, False)]
    assert whole.pages == 6 and [k.repeated for k in whole.kids[0].kids] == [True]
    half = [html.fold_pages(pages[i::2], False) for i in range(2)]
    both = html._joined(html.load(html.dump(half[0])), html.load(html.dump(half[1])))
    assert both.pages == 6 and {p.sig for p, _ in html.walk(both)} == {p.sig for p, _ in html.walk(whole)}
    assert both.kids[0].kids[0].kids[0].texts == {html.text_key("x"): [6, 1]}


def test_html_of_any_depth_and_length(spark):
    deep = "<div>" * 5000 + "core text" + "</div>" * 5000
    unclosed = "".join(f"<h2>a{i}<h3>b{i}<p>c{i}" for i in range(2500))
    strange = "</x>" * 3000 + "<b>" * 3000 + "word " * 200_000
    rows = [(i, f"http://h{k}.example/{i}", page) for k, page in enumerate((deep, unclosed, strange)) for i in range(5)]
    got = {(r["page_id"], r["url"][8]): r["text"] for r in collected(html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")))}
    assert got[0, "0"] == "core text" and got[4, "2"] == " ".join(["word"] * 200_000)
    assert got[2, "1"] == " ".join(f"a{i} b{i} c{i}" for i in range(2500))


def test_names_inside_an_article_and_odd_markup():
    page = (
        '<html><body><nav>menu</nav><div class="related-work">outside</div><article><h1>T</h1><p class="related-work">Earlier work.</p><section id="reply-to-critics"><p>Answer.</p></section>'
        "<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds.</p><svg><title>icon</title><text>Label</text></svg>"
        '<div class="related-posts"><a href=x>more</a></div><ul id="comment-list"><li>first!</li></ul><p title="oops>Last one.</p></article><footer>f</footer></body></html>'
    )
    assert html.extract(page) == "T Earlier work. Answer. So x=1 holds. Label Last one."
    assert html.extract('<article><p>a</p><p title="oops>b</p><p>c</p></article>') == "a b c"
    assert html.extract("<article>a<p class='it\"s'>b</p></article>") == "a b"


def test_scores_do_not_depend_on_the_layout(spark, corpus):
    """The same table in one and in nine partitions, in another order; the long text has several steps of several pieces."""
    rng = random.Random(31)
    rows = [(1000 + i, t) for i, (_, t) in enumerate(corpus)] + [(5000 + i, prose(rng, rng.randint(5, 400))) for i in range(300)] + [(9000, prose(rng, 9000)), (9001, prose(rng, 30000))]
    schema = "doc_id long, text string"
    one = {r["doc_id"]: r["score"] for r in collected(lm.lm_scores(spark.createDataFrame(rows, schema).coalesce(1)))}
    rng.shuffle(rows)
    nine = {r["doc_id"]: r["score"] for r in collected(lm.lm_scores(spark.createDataFrame(rows, schema).repartition(9)))}
    assert max(abs(one[i] - nine[i]) for i in one) < 1e-9
    owner = np.repeat(np.arange(6), [3, 1, 9, 2, 2, 1])
    for size in (1, 2, 4, 100):
        cuts = list(lm.whole_runs(owner, size))
        assert cuts[0][0] == 0 and cuts[-1][1] == len(owner) and all(b == c for (_, b), (c, _) in zip(cuts, cuts[1:], strict=False))
        assert all(owner[a - 1] != owner[a] for a, _ in cuts[1:]) and all(b - a <= max(size, 9) for a, b in cuts)
