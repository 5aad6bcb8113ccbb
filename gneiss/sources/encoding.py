"""The encoding of a text file from its first bytes.

Marks at the start and the pattern of zero bytes tell the wide encodings, validity tells UTF-8. Any other text is
decoded by each candidate and judged as writing: which scripts its letters belong to, whether words keep to one
script, whether capitals stand where words begin, and how common the letters are in the languages of a code page.
Spark reads few charsets by itself. Every one here but the wide ones keeps ASCII where it is, so files are read
byte by byte (ISO-8859-1) and their strings are turned to text after: one-byte sets by `translate`, others by an
Arrow function.
"""

from __future__ import annotations

import codecs
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BY_SPARK = ("UTF-8", "UTF-16LE", "UTF-16BE", "UTF-32", "ISO-8859-1", "US-ASCII")
MARKS = ((codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF32_LE, "UTF-32"), (codecs.BOM_UTF32_BE, "UTF-32"), (codecs.BOM_UTF16_LE, "UTF-16LE"), (codecs.BOM_UTF16_BE, "UTF-16BE"))
ONE_BYTE = ("windows-1252", "windows-1250", "windows-1251", "windows-1253", "windows-1254", "windows-1255", "windows-1256", "KOI8-R", "ISO-8859-2", "ISO-8859-5", "ISO-8859-7")
WIDER = ("Shift_JIS", "EUC-JP", "EUC-KR", "Big5", "GB18030")
# letters beyond ASCII that the languages of a Latin code page use most
LETTERS = {
    "windows-1252": "àâáäãåæçéèêëíîïìñóôöòõøúùûüÿœß’“”«»–",
    "windows-1250": "ąćęłńóśźżčďěňřšťůžőűáéíúýöüâîăşţ’„”–",
    "ISO-8859-2": "ąćęłńóśźżčďěňřšťůžőűáéíúýöüâîăşţ",
    "windows-1254": "çğıöşüâîû’“”",
}
# the most frequent characters of running text, in which wrongly decoded text is poor
FREQUENT = {
    "GB18030": "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里",
    "Big5": "的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作裡",
}
COMMON = {"CYRILLIC": "оеаинтсрвлк", "GREEK": "αοιετσνηυρπκ", "HEBREW": "יוהלארתבשמנ", "ARABIC": "المنيوترةبد"}
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "HEBREW", "ARABIC", "HIRAGANA", "KATAKANA", "CJK", "HANGUL")
HOME = {"windows-1251": "CYRILLIC", "KOI8-R": "CYRILLIC", "ISO-8859-5": "CYRILLIC", "windows-1253": "GREEK", "ISO-8859-7": "GREEK", "windows-1255": "HEBREW", "windows-1256": "ARABIC", "EUC-KR": "HANGUL", "Big5": "CJK", "GB18030": "CJK"}
MIN_SCORE = 0.2


@cache
def script(c: str) -> str | None:
    name = unicodedata.name(c, "")
    return next((s for s in SCRIPTS if name.startswith(s)), None)


def decoded(raw: bytes, encoding: str) -> str | None:
    """The text, or null where the bytes break the encoding's rules before their last few."""
    try:
        return codecs.getincrementaldecoder(encoding)().decode(raw, False)
    except UnicodeDecodeError as e:
        return None if e.start < len(raw) - 8 else raw[: e.start].decode(encoding)


def score(text: str, encoding: str) -> float:
    """How well a decoded text reads, per character beyond ASCII: 1 for common letters of the set's own script."""
    total = good = 0.0
    before, home = "", HOME.get(encoding)
    frequent = FREQUENT.get(encoding, "")
    for c in text:
        if ord(c) > 127:
            total += 1
            kind = script(c)
            if not c.isalpha():
                good += 0.5 if unicodedata.category(c) in ("Pd", "Pi", "Pf", "Po", "Ps", "Pe", "Zs") else -1 if unicodedata.category(c) in ("Cc", "Co", "Cn", "So", "Sm") else 0
            elif kind == "LATIN":
                good += 1 if c.lower() in LETTERS.get(encoding, LETTERS["windows-1252"]) else -0.5
                if before.isalpha() and ord(before) > 127:
                    good -= 0.6  # letters with marks stand among plain ones
            elif encoding in ("Shift_JIS", "EUC-JP"):
                good += {"HIRAGANA": 1.2, "KATAKANA": 0.6, "CJK": 0.4}.get(kind or "", -1) if unicodedata.east_asian_width(c) != "H" else -0.6
            elif kind == home:
                good += (1.2 if c in frequent else 0.5) if frequent else (1.3 if c.lower() in COMMON[kind] else 0.5) if kind in COMMON else 1
            else:
                good -= 1
            if before.isalpha() and kind in ("LATIN", "CYRILLIC", "GREEK"):
                if script(before) != kind:
                    good -= 1
                elif before.islower() and c.isupper():
                    good -= 1
                elif before.isupper() and c.isupper():
                    good -= 0.3
        elif ord(c) > 127 - 32 and before and ord(before) > 127 and before.isalpha() and c.isalpha() and script(before) not in ("LATIN", None):
            good -= 0.5  # an ASCII letter right behind one of another script
        before = c
    return good / total if total else 0.0


def detect(raw: bytes, whole: bool = True) -> str:
    """The likeliest encoding of the first bytes of a file; whole: whether they are all of it."""
    for mark, name in MARKS:
        if raw.startswith(mark):
            return name
    zeros = [raw[i : 1 << 16 : 2].count(0) for i in (0, 1)]
    half = max(1, min(len(raw), 1 << 16) // 2)
    if max(zeros) > 0.3 * half > 0.05 * half >= min(zeros):
        return "UTF-16BE" if zeros[0] > zeros[1] else "UTF-16LE"
    if all(b < 128 for b in raw):
        return "UTF-8"
    try:
        raw.decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError as e:
        if not whole and e.start >= len(raw) - 4:
            return "UTF-8"
    best, most = "ISO-8859-1", MIN_SCORE
    for name in (*WIDER, *ONE_BYTE):
        text = decoded(raw, name)
        if text is not None and (got := score(text, name)) > most:
            best, most = name, got
    return best


def as_text(c: Column, encoding: str) -> Column:
    """A string that was read byte by byte, as text of the encoding; bytes that have none become U+FFFD."""
    if encoding in BY_SPARK:
        return c
    if encoding in ONE_BYTE:
        high = range(128, 256)
        return F.translate(c, "".join(map(chr, high)), "".join(bytes([b]).decode(encoding, "replace") for b in high))

    def decode(column: pa.Array) -> pa.Array:
        return pa.array([None if v is None else v.encode("latin-1").decode(encoding, "replace") for v in column.to_pylist()], pa.string())

    return F.arrow_udf(decode, "string")(c)
