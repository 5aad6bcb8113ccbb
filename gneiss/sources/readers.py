"""Readers. Text files are sniffed on a bounded prefix and read by Spark as strings."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators.predicates import column
from gneiss.profile.infer import infer_types, parsed_time, plain_number
from gneiss.sources.encoding import BY_SPARK, as_text, detect

PREFIX_BYTES = 1 << 20
TELLING_LINES, TELLING_BYTES = 256, 1 << 12
EXTENSIONS = {"csv": ",", "tsv": "\t", "txt": None}


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    quote: str = '"'
    escape: str = '"'
    encoding: str = "UTF-8"
    multiline: bool = False  # quoted fields with line ends; a file is then read by one task
    line_end: str | None = None  # set for wide encodings, where Spark must be told


def visible_files(spark: SparkSession, path: str) -> list:
    """(file system, status) of a file, or of a folder's files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    own = fs.getFileStatus(p)
    return [(fs, s) for s in fs.listStatus(p) if s.isFile() and not s.getPath().getName().startswith(("_", "."))] if own.isDirectory() else [(fs, own)]


def prefix(spark: SparkSession, path: str, size: int = PREFIX_BYTES) -> bytes:
    """First bytes of a file, or of a folder's largest one (empty tasks write files of a header alone), through Spark's file systems."""
    fs, largest = max(visible_files(spark, path), key=lambda f: f[1].getLen())
    stream = fs.open(largest.getPath())
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(min(size, largest.getLen()))))
    finally:
        stream.close()


def telling(spark: SparkSession, path: str, raw: bytes) -> bytes:
    """Lines with bytes beyond ASCII from anywhere in the files, where the first bytes have none and are not all: only such bytes tell the encoding."""
    if not raw.isascii() or b"\0" in raw or sum(s.getLen() for _, s in visible_files(spark, path)) <= len(raw):
        return b""
    at = F.regexp_instr("value", F.lit("[^\\x00-\\x7F]"))
    lines = spark.read.text(path).where(at > 0).select(F.substring(F.col("value").cast("binary"), at, F.lit(TELLING_BYTES)).alias("line")).limit(TELLING_LINES).collect()
    whole_characters = lambda b: re.sub(rb"(?s)(?<=[\x00-\x2f])[^\x00-\x2f]*\Z", b"", b) if len(b) == TELLING_BYTES else b  # no charset has such bytes inside a character
    return b"\n".join(whole_characters(bytes(r["line"])) for r in lines)


def sniff(raw: bytes, whole: bool | None = None, later: bytes = b"") -> Dialect:
    """Encoding and dialect of a delimited file's first bytes; later: lines that tell the encoding where these don't."""
    whole = len(raw) < PREFIX_BYTES if whole is None else whole
    encoding = detect(later) if later else detect(raw, whole)
    text = raw.decode(encoding, "replace").lstrip("\ufeff")
    try:
        d = csv.Sniffer().sniff(text[:65536], delimiters=",;\t|")
        found = Dialect(d.delimiter, d.quotechar or '"', '"' if d.doublequote else (d.escapechar or "\\"), encoding)
    except csv.Error:
        found = Dialect(encoding=encoding)
    wide = encoding.startswith(("UTF-16", "UTF-32"))
    return replace(found, multiline=_has_line_ends(text, found), line_end=("\r\n" if "\r\n" in text else "\n") if wide else None)


def _has_line_ends(text: str, d: Dialect) -> bool:
    """Whether a quoted field holds a line end, in more than a stray quote's way: the records then have as many fields as the header."""
    if d.quote not in text:
        return False
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=d.delimiter, quotechar=d.quote, doublequote=d.escape == d.quote, escapechar=None if d.escape == d.quote else d.escape))[:-1]
    return any(len(r) == len(rows[0]) and any("\n" in f for f in r) for r in rows)


def field_count(raw: Column, d: Dialect) -> Column:
    """Fields of a raw record: a small state machine over its characters.

    States: 0 a field begins, 1 inside a plain field, 2 inside a quoted one, 3 behind a quote in one, 4 behind an escape.
    """
    state, fields = (lambda a: a["state"]), (lambda a: a["fields"])
    own = d.escape != d.quote  # the escape is a character of its own

    def step(a: Column, c: Column) -> Column:
        ends = (c == d.delimiter) & state(a).isin(0, 1, 3)
        nxt = (
            F.when(ends, 0)
            .when(state(a) == 0, F.when(c == d.quote, 2).otherwise(1))
            .when(state(a) == 2, F.when(c == d.escape, 4).when(c == d.quote, 3).otherwise(2) if own else F.when(c == d.quote, 3).otherwise(2))
            .when(state(a) == 3, (F.lit(1) if own else F.when(c == d.quote, 2).otherwise(1)))
            .when(state(a) == 4, 2)
            .otherwise(1)
        )
        return F.struct(nxt.cast("int").alias("state"), (fields(a) + ends.cast("int")).alias("fields"))

    return F.aggregate(F.split(raw, ""), F.struct(F.lit(0).alias("state"), F.lit(1).alias("fields")), step, fields)


def read_delimited(spark: SparkSession, path: str, dialect: Dialect | None = None) -> DataFrame:
    """All columns as strings. Records with more fields than the header go; short ones end in nulls.

    Records are parsed with one field more than the header, whichever columns are asked for. One that fits this is too long by one; of the others only
    those with so many delimiters that they may be too long are looked at character by character.
    """
    if dialect is None:
        first = prefix(spark, path)
        dialect = sniff(first, later=telling(spark, path, first))
    d = dialect
    read_as = d.encoding if d.encoding in BY_SPARK else "ISO-8859-1"
    options = {"sep": d.delimiter, "quote": d.quote, "escape": d.escape, "encoding": read_as, "header": True, "enforceSchema": False, "multiLine": d.multiline, **({"lineSep": d.line_end} if d.line_end else {})}
    names = spark.read.options(**options).csv(path).columns
    corrupt, extra = "__raw", "__extra"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, extra, corrupt]])
    rows = spark.read.schema(schema).options(**{**options, "enforceSchema": True}, mode="PERMISSIVE", columnPruning=False, columnNameOfCorruptRecord=corrupt).csv(path)
    raw = column(corrupt)
    delimiters = F.length(raw) - F.length(F.replace(raw, F.lit(d.delimiter), F.lit("")))
    fits = raw.isNotNull() & column(extra).isNull() & F.when(delimiters < len(names), True).otherwise(field_count(raw, d) <= len(names))
    titles = [n if d.encoding in BY_SPARK else n.encode("latin-1", "replace").decode(d.encoding, "replace") for n in names]
    return rows.where(fits).select(*[as_text(column(n), d.encoding).alias(t) for n, t in zip(names, titles, strict=True)])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of flat records; the columns are the keys of the first record, in name order of Spark's schema."""
    df = spark.read.option("multiLine", True).json(path)
    first = df.limit(1).collect()
    keep = [c for c in df.columns if not first or first[0][c] is not None]
    return df.select(*[column(c) for c in keep or df.columns])


def read_excel(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """S3: one table per non-empty sheet; needs an Excel reader for pandas."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("reading Excel files needs openpyxl") from e
    import io

    import pandas as pd

    sheets = pd.read_excel(io.BytesIO(prefix(spark, path, 1 << 30)), sheet_name=None, dtype=str)
    return {name: spark.createDataFrame(s) for name, s in sheets.items() if len(s)}


def read(spark: SparkSession, path: str) -> DataFrame:
    """By extension: csv, tsv, txt, json, or any table format that Spark reads."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in EXTENSIONS:
        return read_delimited(spark, path, Dialect(EXTENSIONS[kind]) if kind == "tsv" else None)
    if kind == "json":
        return read_json(spark, path)
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).load(path)
    raise ValueError(f"no reader for .{kind}")


def check_limits(df: DataFrame, rows: int | None = None, columns: int | None = None) -> None:
    """An error for a table beyond the limits; reads `rows` + 1 rows at most."""
    if columns is not None and len(df.columns) > columns:
        raise ValueError(f"over {columns} columns")
    if rows is not None and df.limit(rows + 1).count() > rows:
        raise ValueError(f"over {rows} rows")


def coerce(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Strings to their semantic types; what doesn't parse is null, NaN too."""
    out = {}
    for name, kind in types.items():
        c = column(name)
        text = isinstance(df.schema[name].dataType, T.StringType)
        plain = plain_number(c) if text else c
        if kind in ("integer", "year"):
            x = plain.try_cast("double")
            out[name] = F.when(~F.isnan(x) & (x == F.floor(x)), x.try_cast("bigint"))
        elif kind in ("decimal", "latitude", "longitude"):
            x = plain.try_cast("double")
            out[name] = F.when(~F.isnan(x), x)
        elif kind == "datetime" and text:
            out[name] = parsed_time(c)
    return df.withColumns(out) if out else df


def with_nulls(df: DataFrame, tokens: Sequence[str] = ("", "NA", "N/A", "n/a", "na", "NaN", "None", "null", ".")) -> DataFrame:
    """Missing-value words to nulls, in string columns."""
    return df.withColumns({f.name: F.when(~F.trim(column(f.name)).isin(*tokens), column(f.name)) for f in df.schema if isinstance(f.dataType, T.StringType)})


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """Read, infer and coerce."""
    df = with_nulls(read(spark, path))
    return coerce(df, {t.name: t.type for t in infer_types(df)})


def register_catalog(spark: SparkSession, catalog: Mapping[str, str]) -> None:
    """Name -> path, as temporary views."""
    for name, path in catalog.items():
        read(spark, path).createOrReplaceTempView(name)
