"""The pipeline's stages and sentence dedup against brute-force versions."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_operators import prose, repeats, shingles, words
from tokenizers import Tokenizer

from gneiss.llm import quality, sentences, suffixes

SF = "/root/testdata/sf0.001"


def test_every_stage_does_its_whole_work(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id", "left_semi").orderBy("doc_id").limit(6).collect()
    base = [r["text"] for r in good]
    passage = prose(rng, 60)
    more = [(None, base[0]), (None, base[0]), (good[1]["doc_id"], base[1]), (900001, base[2] + " extra"), (900002, None), (900003, ""), (900004, base[3] + "\n" + passage), (900005, passage + "\n" + base[4]), (900006, base[5] + " " + items[0][1])]
    extra = spark.createDataFrame([(i, t, "en", "made", len(t or "")) for i, t in more], docs.schema)
    docs.union(extra).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    seen = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    write = corpus_pipeline.materialize
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda df, name, parts=None: (seen.append(write(df, name, parts)), seen[-1])[1])
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    start, kept, single, cut, clean, _ = [[(r["doc_id"], r["text"]) for r in df.collect()] if "text" in df.columns else None for df in seen]

    scores = quality.quality_scores(seen[0], spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    assert len(kept) == sum(r["predicted"] for r in scores) and not Counter(kept) - Counter(start)

    sets = [shingles(t) for _, t in kept]
    root = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if kept[a] == kept[b] or both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    groups = {}
    for k, r in enumerate(root):
        groups.setdefault(r, []).append(kept[k])
    assert len(single) == len(groups)
    for rows in groups.values():
        least = min(rows, key=lambda x: (x[0] is None, x[0] or 0))
        assert sum(s in rows for s in set(single)) == 1 and any(s in rows and s[0] == least[0] for s in single)

    raws = [(t or "").encode() for _, t in single]
    want = Counter((i, None if t is None else np.frombuffer(r, np.uint8)[~gone[1:-1]].tobytes().decode("utf-8", "ignore")) for (i, t), r, gone in zip(single, raws, repeats(raws, suffixes.SHORT), strict=True))
    assert Counter(cut) == want and all(passage not in (t or "") for _, t in cut)

    def leaks(text):
        w = words(text)
        for _, item in items:
            b = words(item)
            if not b or not w:
                continue
            k, m = min(5, len(b)), min(len(b), len(w))
            grams = lambda x, k=k: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
            cb, all_grams = grams(b), grams(w)
            if not any(g in all_grams for g in cb):
                continue
            for a in range(len(w) - m + 1):
                cw = grams(w[a : a + m])
                less = sum((cw & cb).values())
                if less and 100 * less >= 80 * (sum(cw.values()) + sum(cb.values()) - less):
                    return True
        return False

    assert Counter(clean) == Counter(r for r in cut if not leaks(r[1]))

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = Counter()
    for i, text in clean:
        n = len(t.encode(text or "", add_special_tokens=False).ids) + 1
        lengths.update((i, k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048)))
    assert Counter((None if i != i else int(i), p, n) for i, p, n in packed[["doc_id", "piece", "length"]].itertuples(index=False)) == lengths
    packed = packed.sort_values(["sequence_id", "offset"])
    assert (packed.groupby("sequence_id").length.cumsum() - packed.length == packed.offset).all() and packed.groupby("sequence_id").length.sum().max() <= 2048


def cut_sentences(text):
    """Sentences of a text as lists of words."""
    out = []
    for line in (text or "").split("\n"):
        now = []
        for w in words(line):
            now.append(w)
            if w[-1:] in (b".", b"!", b"?"):
                out.append(now)
                now = []
        if now:
            out.append(now)
    return out


def test_sentence_spans_by_brute_force(spark):
    rng = random.Random(12)
    passages = [prose(rng, rng.randint(25, 90)) for _ in range(8)]
    rows = [(i, "\n".join([prose(rng, rng.randint(5, 60)), rng.choice(passages), prose(rng, rng.randint(5, 60)), *([rng.choice(passages)] if i % 3 == 0 else [])])) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "one two."), (103, passages[0] + "\n" + passages[0])]
    spans = {}
    for i, text in rows:
        s = cut_sentences(text)
        mine = {}
        for k in range(len(s)):
            if len(s[k]) >= 40:
                mine[2 * k] = (k, k)
                continue
            j = next((j for j in range(k + 1, len(s)) if sum(map(len, s[k : j + 1])) >= 20), None)
            if j is not None:
                mine[2 * k] = (k, j)
        for k in range(len(s)):
            j = next((j for j in range(k - 1, -1, -1) if sum(map(len, s[j : k + 1])) >= 20), None) if len(s[k]) < 40 else None
            if j is not None and mine.get(2 * j) != (j, k):
                mine[2 * k + 1] = (j, k)
        for number, (a, b) in mine.items():
            spans.setdefault(tuple(w for x in s[a : b + 1] for w in x), []).append((i, number, a, b))
    gone = {i: set() for i, _ in rows}
    for found in spans.values():
        for i, _, a, b in sorted(found)[1:]:
            gone[i] |= set(range(a, b + 1))
    got = {r["doc_id"]: r for r in sentences.repeated_sentences(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert sum(map(len, gone.values())) > 20
    for i, text in rows:
        s = cut_sentences(text)
        assert (got[i]["n_sentences"], got[i]["n_removed"]) == (len(s), len(gone[i]))
        assert words(got[i]["text"]) == [w for k, x in enumerate(s) if k not in gone[i] for w in x]


def test_pipeline_names_its_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]
