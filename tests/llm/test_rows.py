"""Rows rather than ids: repeated ids, null ids, clashing names, tables left behind, and very long texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import common, decontam, jaccard, lm, quality, rules, sentences

SYLLABLES = "an the ti on ed re in er ing ou ha st é ß nt or".split()


def prose(rng, n, line=0):
    out = []
    for i in range(n):
        w = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
        out.append(w + (".\n" if line and i % line == line - 1 else ""))
    return " ".join(out)


def test_keep_one_carries_all_columns(spark):
    rng = random.Random(1)
    a = prose(rng, 40)
    df = spark.createDataFrame([(1, a, 7, "x"), (2, a, 8, "y"), (None, a, 9, "z")], "doc_id long, text string, __row long, row string")
    assert [tuple(r) for r in jaccard.keep_one(df).collect()] == [(1, a, 7, "x")]


def test_clean_lines_judges_rows(spark):
    rng = random.Random(2)
    good = "\n".join(prose(rng, 12) + "." for _ in range(6))
    bad = "\n".join("| home | about | # menu #" for _ in range(9))
    df = spark.createDataFrame([(1, good), (1, bad), (None, good), (2, bad), (3, None), (4, good + "\n| # menu # |")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in rules.clean_lines(df).collect()))
    assert got == [(0, good), (1, good), (4, good)]


def test_a_labelled_id_trains_once(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 30)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    plain = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    many = spark.createDataFrame(rows + [rows[5]] * 300 + [rows[8]] * 20, "doc_id long, text string").repartition(7)
    assert np.array_equal(plain, quality.train(many, labels))


def test_ftrl_equals_the_plain_update():
    """The textbook's update over all weights, one document after another."""
    rng = np.random.default_rng(4)
    size, alpha, beta, l1, l2 = 1 << quality.BITS, 0.3, 1.0, 0.002, 0.02
    docs = [(np.append(np.sort(rng.choice(40, 6, False)), size), np.append(rng.random(6), 1.0)) for _ in range(50)]
    labels = rng.integers(0, 2, 50).astype(float)
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(2):
        for (idx, x), y in zip(docs, labels, strict=True):
            w = [weight(i) for i in idx]
            p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            for i, a, v in zip(idx, w, x, strict=True):
                g = (p - y) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * a
                n[i] += g * g
    got = quality.ftrl(docs, labels, 2, alpha, beta, l1, l2)
    assert np.allclose(got, [weight(i) for i in range(size + 1)])


def test_tables_left_behind_are_released(spark):
    common.release()
    a, b = (common.materialize(spark.range(5), "left") for _ in range(2))
    common.discard(a)
    assert b.count() == 5 and common.release() == 1 and common.release() == 0
    with pytest.raises(Exception):
        spark.read.parquet(b._gneiss_path).count()


def test_decontamination_in_many_passes_drops_the_same_rows(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, prose(rng, 25)) for i in range(30)]
    docs = spark.createDataFrame([(i, prose(rng, 40) + (" " + items[i][1] if i < 9 else "")) for i in range(60)], "doc_id long, text string").withColumn("n", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect())
    monkeypatch.setattr(decontam, "passes", lambda b: [p for k in range(5) for p in _passes(b.where(F.col("item_id") % 5 == k))])
    many = decontam.drop_contaminated(docs, bench)
    assert one == list(range(9, 60)) == sorted(r["doc_id"] for r in many.collect()) and many.columns == docs.columns
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == 60


_passes = decontam.passes


def test_very_long_texts(spark):
    """A text of some six megabytes beside short ones, through the operators that read words, lines and sentences."""
    rng = random.Random(8)
    some = [prose(rng, 3000, 15) for _ in range(20)]
    long = "\n".join(some[i % 20] + f" turn{i}." for i in range(340))
    assert len(long) > 5 << 20
    rows = [(0, long), (1, long + " end"), (2, prose(rng, 50, 15)), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    assert near == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    judged = {r["doc_id"]: r for r in rules.quality_rules(df).collect()}
    assert judged[0]["n_words"] == len(long.split()) and judged[0]["base_failed"]
    cut = {r["doc_id"]: r for r in sentences.repeated_sentences(df).collect()}
    assert 0 < len(cut[0]["text"]) < 0.2 * len(long) and cut[3]["text"] is None and cut[2]["n_removed"] == 0
    scores = {r["doc_id"]: r for r in lm.lm_scores(df).collect()}
    assert scores[0]["n_tokens"] == len(long.split()) + 1 and scores[0]["score"] < 0
    weights = np.zeros((1 << quality.BITS) + 1, np.float32)
    assert {r["score"] for r in quality.score(df, weights).collect()} == {0.5}
