"""Operator 5: quality rules, line first, in built-in functions only.

Each line is judged alone (terminal punctuation, symbols and menu bars, shouting, boilerplate phrases);
failing lines go, and a text that loses more than `max_lost` per cent of its line characters is rejected.
A base check over the whole text comes first: at least ten words, and at most a fifth of them inside
five-word windows that occur twice or more.

Windows are compared by 64-bit hashes inside one text. Only a text that has equal hashes pays for
the sorting: hash and position are packed into one long, sorted, and neighbours compared, so cost
stays n log n for texts of any length. Everything is a projection: no shuffle, no Python.

Defined cases: a null or empty text has no words, so base_failed is true and kept false; rows repeat
as they come; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import id_and_text

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
SYMBOLS = r"[#*$%&|<>]"
ENDING = rf"[.!?:;\x22')\]…»”’][{SPACE}]*$"
BOILERPLATE = (
    r"(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript"
    r"|lorem ipsum|click here|subscribe now|sign up now|skip to content|powered by wordpress)"
)
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT = 20
MAX_LOST = 40
SHORT_LINE = 30
SIGN_EVERY = 18


def failing_line(line: Column) -> Column:
    """True for a line that breaks one of the line rules."""
    size = F.char_length(line)
    return (
        (SIGN_EVERY * F.regexp_count(line, F.lit(SYMBOLS)) > size)
        | (SIGN_EVERY * F.regexp_count(line, F.lit("!!")) > size)
        | ((size >= SHORT_LINE) & ~line.rlike(ENDING))
        | line.rlike(BOILERPLATE)
    )


def with_words(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return id_and_text(docs).select(
        "doc_id",
        text.alias("text"),
        F.array_remove(F.split(text, rf"[{SPACE}]+"), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{SPACE}]")).alias("lines"),
    )


def _let(name: str, value: str, body: str) -> str:
    """SQL for body with name bound to value, which is evaluated once however often body names it, and wherever the optimizer copies the whole."""
    return f"transform(array({value}), {name} -> {body})[0]"


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_words and n_repeat_words from the column words.

    The steps are nested bindings, not columns: a filter on the result is pushed down by copying the
    columns' expressions into each other, and a step inside a lambda would then run for each element.
    """
    k = WINDOW
    at = ", ".join(f"get(h, i + {j})" for j in range(k))
    win = f"CASE WHEN size(h) >= {k} THEN transform(sequence(0, size(h) - {k}), i -> xxhash64({at})) ELSE CAST(array() AS ARRAY<BIGINT>) END"
    same = "get(keys, j).x = get(keys, {}).x"
    found = (
        f"sort_array(transform(filter(sequence(0, size(keys) - 1), j -> coalesce({same.format('j - 1')}, false) OR coalesce({same.format('j + 1')}, false)),"
        " j -> get(keys, j).i))"
    )
    covered = f"CASE WHEN size(found) > 0 THEN aggregate(sequence(0, size(found) - 1), 0L, (a, j) -> a + least({k}L, coalesce(get(found, j + 1) - get(found, j), {k}L))) ELSE 0L END"
    # keys are sorted only where two windows agree; all 64 bits of their hashes are compared
    keys = "sort_array(transform(win, (x, i) -> struct(x AS x, i AS i)))"
    sort = _let("keys", keys, _let("found", found, covered))
    count = f"CASE WHEN size(array_distinct(win)) < size(win) THEN {sort} ELSE 0L END"
    repeats = _let("h", "transform(words, w -> xxhash64(w))", _let("win", win, count))
    return df.withColumns({"n_words": F.size("words").cast("long"), "n_repeat_words": F.expr(repeats)})


def quality_rules(docs: DataFrame, max_lost: int = MAX_LOST) -> DataFrame:
    """One row per document: the base counts, the lines' losses and the verdict."""
    return _judged(docs, max_lost).drop("text")


def _judged(docs: DataFrame, max_lost: int) -> DataFrame:
    lost = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.when(failing_line(x), F.char_length(x)).otherwise(0))
    lines = F.size("lines").cast("long")
    counted = with_repeats(with_words(docs)).select(
        "doc_id",
        "text",
        "n_words",
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        lines.alias("n_lines"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("line_chars"),
        lost.alias("lost_chars"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("lost_chars") <= max_lost * F.col("line_chars")))


def clean_lines(docs: DataFrame, max_lost: int = MAX_LOST) -> DataFrame:
    """The kept rows with their failing lines removed; blank lines stay. Each row is judged by itself, whatever its id."""
    text = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~failing_line(x) | ~x.rlike(rf"[^{SPACE}]")), "\n")
    return _judged(docs, max_lost).where("kept").select("doc_id", text.alias("text"))


def oracle() -> str:
    blank, quote = rf"[^{SPACE}]", "''"
    ending = ENDING.replace("'", quote)
    rule = (
        f"({SIGN_EVERY} * len(regexp_extract_all(x, '{SYMBOLS}')) > length(x) OR {SIGN_EVERY} * len(regexp_extract_all(x, '!!')) > length(x)"
        f" OR (length(x) >= {SHORT_LINE} AND NOT regexp_matches(x, '{ending}')) OR regexp_matches(x, '{BOILERPLATE}'))"
    )
    return rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), parts AS (
  SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{blank}')) AS lines FROM base
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM parts)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY doc_id
), counted AS (
  SELECT p.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS BIGINT) AS line_chars,
    CAST(coalesce(list_sum(list_transform(lines, lambda x: CASE WHEN {rule} THEN length(x) ELSE 0 END)), 0) AS BIGINT) AS lost_chars
  FROM parts p LEFT JOIN covered c USING (doc_id)
)
SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND 100 * lost_chars <= {MAX_LOST} * line_chars AS kept
FROM counted"""
