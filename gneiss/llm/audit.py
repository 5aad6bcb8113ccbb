"""Operator 11: audit of how quality filters interact, from one CUBE over their failure flags.

Five filters (`RULES` on the text alone, and copies of an earlier text) mark each document. Documents are
counted by part and flags first; SQL CUBE over part and flags then gives every grouping set, and the row of
a set of flags whose flags are all false is what survives those filters. Filters remove the same documents
in whichever order the earlier ones ran, so a step of an order is a pair of subsets, before and after: 80
pairs stand for all 600 steps of the 120 orders.

Texts are never moved: a SHA-256 stands for each, and rows of one text, part and label are added up before
texts are compared over the table, so a hot text is a few rows by then. From the cells on, the tables have
parts times at most 600 rows.

Defined cases: a null text is empty, a null part the empty string; a null id is no one's earlier copy,
is never a copy itself and has no label; repeated rows of an id count each, and neither is the other's
earlier copy; an id labelled more than once is good or toxic if any of its labels says so; without
documents there are no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import discard, materialize

SPACE = r"\x20\x09-\x0D"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
SPREAD = 1024  # groups that rows without an id are dealt over

# a filter fails a document by its text and its array of words
RULES: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < MIN_WORDS,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS * F.char_length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
COPY = "E"


def flagged(docs: DataFrame, rules: Mapping[str, Callable[[Column, Column], Column]] = RULES, part_col: str = "source") -> DataFrame:
    """(doc_id, part, digest, a flag for each rule, n): equal rows are counted where they are read."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(F.col("text"), rf"[{SPACE}]+"), "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text")).select("*", words.alias("words"))
    flags = [rule(F.col("text"), F.col("words")).alias(letter) for letter, rule in rules.items()]
    marked = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), *flags)
    return marked.groupBy(*marked.columns).agg(F.count("*").alias("n"))


def cells(docs: DataFrame, labels: DataFrame, rules: Mapping[str, Callable[[Column, Column], Column]] = RULES, part_col: str = "source") -> DataFrame:
    """(part, all flags, n, good, toxic): documents of each part by what they fail; written, since it is small and read often."""
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows without an id have no label, and would all meet in one task
    spread = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("digest"), F.lit(SPREAD))).otherwise(0)
    labelled = flagged(docs, rules, part_col).withColumn("spread", spread).join(said.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    keys = ["digest", "part", *rules, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")]
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    nameless = F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless")
    groups = materialize(labelled.groupBy(*keys).agg(F.sum("n").alias("n"), nameless, first), "audit_groups")
    least = groups.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    originals = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.lit(False).alias(COPY), originals.alias("m")), F.struct(F.lit(True).alias(COPY), (F.col("n") - originals).alias("m")))).alias("x")
    each = groups.join(least, "digest").select("part", *rules, "good", "toxic", split).select("*", "x.*").where("m > 0")
    out = materialize(each.groupBy("part", *rules, COPY).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("good")).alias("good"), F.sum(F.col("m") * F.col("toxic")).alias("toxic")), "audit_cells")
    discard(groups)
    return out


def survivors(counted: DataFrame, letters: str) -> DataFrame:
    """(part, mask, n, good, toxic) for each part and each of the 2^k sets of filters, zeros included.

    The first letter is the mask's highest bit.
    """
    every = (1 << len(letters)) - 1
    cube = counted.cube("part", *letters).agg(F.grouping_id().alias("left_out"), *[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    passed = cube.where(F.col("left_out") <= every)  # those that keep the parts apart
    for letter in letters:
        passed = passed.where(~F.coalesce(F.col(letter), F.lit(False)))
    found = passed.select("part", (every - F.col("left_out")).cast("int").alias("mask"), "n", "good", "toxic")
    grid = counted.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(every))).alias("mask"))
    return grid.join(found, ["part", "mask"], "left").na.fill(0, ["n", "good", "toxic"])


def filter_audit(docs: DataFrame, labels: DataFrame, rules: Mapping[str, Callable[[Column, Column], Column]] = RULES, part_col: str = "source") -> DataFrame:
    """One row per part, order of all filters and step: what the step keeps, removes and costs; k! * k rows a part."""
    spark = docs.sparkSession
    letters = "".join([*rules, COPY])
    bit = {c: 1 << (len(letters) - 1 - i) for i, c in enumerate(letters)}
    every = (1 << len(letters)) - 1
    size = lambda mask: bin(mask).count("1")
    # how many orders run exactly the filters of `before` ahead of the letter
    pairs = [(c, m, m | b, factorial(size(m)) * factorial(len(letters) - 1 - size(m))) for c, b in bit.items() for m in range(every + 1) if not m & b]
    steps = [("".join(p), k + 1, p[k], sum(bit[c] for c in p[:k])) for p in permutations(letters) for k in range(len(letters))]
    pair_rows = F.broadcast(spark.createDataFrame(pairs, "letter string, before int, after int, orders long"))  # k * 2^(k-1) rows
    step_rows = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, letter string, before int"))  # k! * k rows

    alive = survivors(cells(docs, labels, rules, part_col), letters)
    before = alive.select("part", F.col("mask").alias("before"), *[F.col(c).alias(f"{c}_before") for c in ("n", "good", "toxic")])
    after = alive.withColumnRenamed("mask", "after")
    lost = before.join(pair_rows, "before").join(after, ["part", "after"])
    lost = lost.select("part", "letter", "before", "orders", F.col("n").alias("kept"), *[(F.col(f"{c}_before") - F.col(c)).alias(name) for c, name in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))])
    others = F.create_map(*[x for c, b in bit.items() for x in (F.lit(c), F.lit(every ^ b))])[F.col("letter")]
    whole = lost.groupBy("part", "letter").agg(
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.col("before") == others, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("orders") * F.col("removed")).alias("shapley"),
    )
    out = lost.join(step_rows, ["letter", "before"]).join(whole, ["part", "letter"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def oracle() -> str:
    """filter_audit of documents and labels, as DuckDB SQL."""
    masks = " + ".join(f"CASE WHEN {c} THEN {16 >> i} ELSE 0 END" for i, c in enumerate("abcde"))
    letter = "CASE ascii(letter) - 65 WHEN 0 THEN 16 WHEN 1 THEN 8 WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 1 END"
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts),
flags AS (
  SELECT doc_id, part, len(w) < {MIN_WORDS} AS a, 100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w) AS b,
         100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {MAX_CAPITALS} * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > first_id, false) AS e FROM words),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, {masks} AS failed, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic
  FROM flags LEFT JOIN said USING (doc_id) GROUP BY ALL),
subsets AS (SELECT range AS mask FROM range(32)),
alive AS (
  SELECT part, mask, sum(CASE WHEN failed & mask = 0 THEN n ELSE 0 END) AS n,
         sum(CASE WHEN failed & mask = 0 THEN good ELSE 0 END) AS good,
         sum(CASE WHEN failed & mask = 0 THEN toxic ELSE 0 END) AS toxic
  FROM cells CROSS JOIN subsets GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
orders AS (
  SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.letter, q.letter, r.letter, s.letter, t.letter])) = 5),
places AS (
  SELECT filter_order, CAST(range AS INTEGER) AS step, substr(filter_order, range, 1) AS letter FROM orders, range(1, 6)),
bits AS (SELECT filter_order, step, letter, {letter} AS bit FROM places),
steps AS (
  SELECT filter_order, step, letter, bit,
         coalesce(sum(bit) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bits),
done AS (
  SELECT part, filter_order, step, letter, bit, y.n AS kept, x.n - y.n AS removed, x.good - y.good AS good_lost, x.toxic - y.toxic AS toxic_lost
  FROM steps s JOIN alive x ON x.mask = s.before JOIN alive y USING (part) WHERE y.mask = s.before + s.bit),
totals AS (
  SELECT part, letter, bit, sum(removed) AS shapley FROM done GROUP BY ALL),
fails AS (
  SELECT t.part, t.letter, t.shapley, none.n - own.n AS fails, others.n - everything.n AS unique_fails
  FROM totals t JOIN alive none ON none.part = t.part AND none.mask = 0 JOIN alive own ON own.part = t.part AND own.mask = t.bit
  JOIN alive others ON others.part = t.part AND others.mask = 31 - t.bit JOIN alive everything ON everything.part = t.part AND everything.mask = 31)
SELECT d.part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(fails - removed AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM done d JOIN fails f ON f.part = d.part AND f.letter = d.letter"""
