"""Semantic types by weighted votes over all rows, in one aggregation for all columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators.predicates import column

# fixed values: votes per value, and the order that settles ties
WEIGHTS = {"integer": 8, "boolean": 7, "decimal": 6, "datetime": 5, "month": 5, "day": 5, "year": 5, "string": 4, "countryCode2": 10, "countryCode3": 10, "countryName": 10, "continentName": 10}
LONGEST = 64
PRIORITY = ("integer", "boolean", "decimal", "continentName", "countryName", "countryCode3", "countryCode2", "month", "day", "year", "datetime", "string")
CONTINENTS = ("Africa", "Antarctica", "Asia", "Australia", "Europe", "North America", "Oceania", "South America")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "mon", "tue", "tues", "wed", "thu", "thur", "thurs", "fri", "sat", "sun")
BOOLEANS = ("yes", "no", "true", "false")
GENERAL = {**dict.fromkeys(("integer", "decimal"), "q"), **dict.fromkeys(("datetime", "date", "time", "year", "month", "day"), "t")}
SCALES = {**dict.fromkeys(("integer", "decimal", "datetime", "date", "time"), "continuous"), **dict.fromkeys(("year", "month", "day"), "ordinal")}
DATE_ORDERS = ("yyyy-M-d", "d-M-yyyy", "d-MMM-yyyy", "MMM-d-yyyy", "d-M-yy")
SEPARATED = r"^(\w+)([-./ ])(\w+)\2(\w+)"
TIMES = ("", " H:m", " H:m:s")
MONTH_NAMES = MONTHS[:12]
MONTHS_3 = tuple(m[:3] for m in MONTH_NAMES)
HAS_MONTH = rf"(?i)^.{{0,24}}\b({'|'.join(MONTHS_3)})[a-z]{{0,6}}\b.*\d"
# day month year, month day year, year month day, or month year, and a time of day
FREE = r"^(?:(\d{1,2}) ([a-z]{3,9}) '?(\d{4}|\d{2})|([a-z]{3,9}) (\d{1,2}) (\d{4})|(\d{4}) ([a-z]{3,9}) (\d{1,2})|([a-z]{3,9}) (\d{4}))(?: (\d{1,2}):(\d{2})(?::(\d{2}))? ?(am|pm)?)?$"
POINTED = r"^[+-]?\d{1,3}((\.\d{3})+,\d+|(\.\d{3}){2,})$"
BLANKS = r"[ \u00A0\u202F']"
BLANKED = rf"^[+-]?\d{{1,3}}({BLANKS}\d{{3}})+([.,]\d+)?$"
LOOKS_LIKE_TIME = r"^(\d{1,4}[-./ ](\d{1,2}|[A-Za-z]{3})[-./ ]\d{1,4}|[A-Za-z]{3}[-./ ]\d{1,2}[-./ ]\d{4})([T ]\d{1,2}:.*)?$"


@cache
def _countries(_: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    jvm = SparkSession.builder.getOrCreate()._jvm  # also from a thread, which has no active session
    locale, english = jvm.java.util.Locale, jvm.java.util.Locale.ENGLISH
    codes = [str(c) for c in locale.getISOCountries()]
    places = [locale("", c) for c in codes]
    return tuple(codes), tuple(str(p.getISO3Country()) for p in places), tuple(sorted({str(p.getDisplayCountry(english)) for p in places}))


def country_tables() -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    """Two-letter codes, three-letter codes and English names, as the Java runtime lists them."""
    return _countries("iso")


def once(c: Column, body: Callable[[Column], Column]) -> Column:
    """body of c, with c evaluated once however often body names it, which keeps the plan and its code small."""
    return F.transform(F.array(c), body)[0]


def plain_number(c: Column) -> Column:
    """The text of a number without grouping marks and with a decimal point.

    Commas group, but where a number can't be read so: points that group before a decimal comma (1.234,56 and
    1.234.567), and groups parted by blanks or apostrophes (1 234,56 and 1'234.56).
    """
    x = F.trim(c)
    pointed, blank = F.replace(F.regexp_replace(x, r"\.", ""), F.lit(","), F.lit(".")), F.replace(F.regexp_replace(x, BLANKS, ""), F.lit(","), F.lit("."))
    return F.when(x.rlike(POINTED), pointed).when(x.rlike(BLANKED), blank).otherwise(F.regexp_replace(x, ",", ""))


def number(c: Column) -> Column:
    return plain_number(c).try_cast("double")


def free_time(c: Column) -> Column:
    """A timestamp out of a date with its month in letters, as people write it: 3rd of May 2019, Friday, May 3, 2019 at
    4:05 pm, 3-May-19, May 2019 (the first). Null for anything else."""
    text = F.lower(F.trim(c))
    for pattern, by in ((r"\b(mon|tues?|wed(nes)?|thu(rs?)?|fri|sat(ur)?|sun)(day)?\b\.?", " "), (r"(\d)(st|nd|rd|th)\b", "$1"), (r"\b(of|at|on|the)\b", " "), (r"[,./-]+", " "), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, by)
    return once(F.trim(text), _free_time)


def _free_time(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, FREE, i)
    number_of = lambda x: F.when(x != "", x).try_cast("int")
    name = F.concat(part(2), part(4), part(8), part(10))  # one of them
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS_3]), F.substring(name, 1, 3)).cast("int")
    day = F.coalesce(number_of(part(1)), number_of(part(5)), number_of(part(9)), F.lit(1))
    year = number_of(F.concat(part(3), part(6), part(7), part(11)))
    year = once(year, lambda y: F.when(y >= 100, y).when(y < 69, y + 2000).otherwise(y + 1900))
    hour, half = F.coalesce(number_of(part(12)), F.lit(0)), part(15)
    hour = once(hour, lambda h: F.when(half == "", h).when(h > 12, 24).otherwise(h % 12 + F.when(half == "pm", 12).otherwise(0)))
    second = F.coalesce(number_of(part(14)), F.lit(0)).cast("decimal(16,6)")
    return F.when(text.rlike(FREE) & (F.lit(",".join(MONTH_NAMES)).contains(name)), F.try_make_timestamp(year, month, day, hour, F.coalesce(number_of(part(13)), F.lit(0)), second))


def parsed_time(c: Column) -> Column:
    """A timestamp by the first of the known forms, day first, or null."""
    x = F.trim(c)
    plain = F.regexp_replace(x, SEPARATED, "$1-$3-$4")  # the same separator twice, whichever it is
    forms = [o + t for o in DATE_ORDERS for t in TIMES]
    iso = F.when(x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), x.try_cast("timestamp"))
    known = F.coalesce(iso, once(plain, lambda p: F.coalesce(*[F.try_to_timestamp(p, F.lit(f)) for f in forms])))
    # a cheap look first: few values of a text column reach the parsers
    return F.coalesce(F.when(x.rlike(LOOKS_LIKE_TIME), known), F.when(x.rlike(HAS_MONTH), free_time(c)))


def detectors(c: Column) -> dict[str, Column]:
    two, three, names = country_tables()
    x, low = F.trim(c), F.lower(F.trim(c))
    n = number(c)
    return {
        "integer": n.isNotNull() & ~F.isnan(n) & (n == F.floor(n)) & ~low.isin("inf", "-inf", "infinity", "-infinity"),
        "decimal": n.isNotNull(),
        "boolean": low.isin(*BOOLEANS),
        "month": low.isin(*MONTHS),
        "day": low.isin(*DAYS),
        "countryCode2": x.isin(*two),
        "countryCode3": x.isin(*three),
        "countryName": x.isin(*names),
        "continentName": x.isin(*CONTINENTS),
        "datetime": parsed_time(c).isNotNull(),
        "string": F.lit(True),
    }


def header_bonus(name: str) -> tuple[str, float] | None:
    """The type that a header suggests, and how much: first rule that fits."""
    low = name.lower()
    for kind in ("year", "month", "day", "datetime"):
        if low == kind or (kind == "datetime" and low in ("date", "time")):
            return kind, 9.0
    if "yob" in low:
        return "year", 5.0
    for kind in ("year", "month", "day", "datetime"):
        if kind in low:
            return kind, 5.0
    if " date" in low or " time" in low:
        return "datetime", 5.0
    return ("boolean", 2.0) if re.match(r"is([A-Z_ ]|$)", name) else None


def storage_type(kind: T.DataType) -> str | None:
    """Type of a column that has one already; strings are voted on."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "decimal"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "boolean" if isinstance(kind, T.BooleanType) else None


@dataclass(frozen=True)
class FieldType:
    name: str
    type: str
    general: str
    scale: str
    scores: dict[str, float]


def settle(name: str, shares: dict[str, float]) -> FieldType:
    scores = {k: v for k, v in shares.items() if v}
    if bonus := header_bonus(name):
        scores[bonus[0]] = scores.get(bonus[0], 0) + bonus[1]
    total = sum(scores.values())
    kind = max(scores, key=lambda k: (scores[k], -PRIORITY.index(k))) if total else "string"
    return FieldType(name, kind, GENERAL.get(kind, "c"), SCALES.get(kind, "nominal"), {k: v / total for k, v in scores.items()} if total else {})


def is_flat(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))


def infer_types(df: DataFrame) -> list[FieldType]:
    """One FieldType per flat column; votes count every non-null row, so nothing depends on a sample.

    Values of all columns are counted first and each distinct one is looked at once. A value of over
    LONGEST characters can only be text, so long ones are counted together and not moved.
    """
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    got: dict[str, float] = {}
    if text:
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), column(c).isNotNull().alias("some"), F.when(F.length(column(c)) <= LONGEST, column(c)).alias("v")) for i, c in enumerate(text)])).alias("x")
        values = df.select(each).select("x.*").where("some").groupBy("i", "v").agg(F.count("*").alias("n"))
        votes = [F.sum(F.when(F.coalesce(p, F.lit(False)), F.col("n")).otherwise(0)).alias(k) for k, p in detectors(F.col("v")).items()]
        for r in values.groupBy("i").agg(F.sum("n").alias("all"), *votes).collect():
            got |= {f"{r['i']}:{k}": float(WEIGHTS[k]) * r[k] / r["all"] for k in WEIGHTS if k in r.asDict()}
    out = []
    for f in df.schema:
        if not is_flat(f.dataType):
            continue
        known = storage_type(f.dataType)
        if known:
            shares = {known: float(WEIGHTS[known])}
        else:
            i = text.index(f.name)
            shares = {k: got.get(f"{i}:{k}", 0.0) for k in PRIORITY}
        out.append(settle(f.name, shares))
    return out


def types_frame(df: DataFrame) -> DataFrame:
    rows = [(t.name, t.type, t.general, t.scale) for t in infer_types(df)]
    return df.sparkSession.createDataFrame(rows, "field string, type string, general_type string, scale string")


def is_id(name: str, kind: str, unique: bool) -> bool:
    """an id by its name; text must be unique for it, integers need not."""
    by_name = name in ("id", "Id", "ID") or name.endswith(("id", "Id", "ID")) or any(x in name for x in ("subject", "Subject", "name", "Name"))
    return by_name and (kind == "integer" or (kind == "string" and unique))


def is_wide_time_series(names: list[str], least: int = 2) -> bool:
    """F16: whether headers look like a series of times, years or numbered periods in a row."""
    marks = [bool(re.fullmatch(r"(1[5-9]|20)\d{2}([-_/ ]?(q[1-4]|\d{1,2}))?|(\d{1,2}[-_/ ])?(1[5-9]|20)\d{2}", n.strip().lower())) for n in names]
    run = best = 0
    for m in marks:
        run = run + 1 if m else 0
        best = max(best, run)
    return best >= max(least, len(names) // 2)
