"""Operator 12: fill-in-the-middle by an index of distinct texts.

1. `text_index` groups equal texts. The text itself is a key of the grouping, so equality is by content, not by
   hash; Spark adds the copies of a map task up before they are shuffled. A text that many documents hold is dealt
   over salts by where its copies are read, so no group grows with the table.
2. Each group's token boundaries are listed once, as code points, in an Elias-Fano code: low bits as they are, high
   bits in unary, with the place of every 256th one. A list takes about a tenth of its text.
3. The groups join back to their documents by the postings they carry, and each document selects its two seeded
   cuts from the list. All else (draws, forms, texts) is built-in functions.

Defined cases: a null text is empty; a null id is drawn as the empty string after the seed; repeated rows give a row
each, alike; an empty table gives an empty one; other columns are ignored; texts of any length are listed in pieces.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm import text as tx
from gneiss.llm.common import id_and_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_RATE, SPM_RATE = 42, 50, 80
HOT_TEXTS = 4096  # most texts that can be dealt over salts
LEAST_SALT = 16
SAMPLE = 256  # every so many ones of the high bits have their place noted
_HEAD = struct.Struct("<QBI")


# --- boundaries -------------------------------------------------------------------------------------


def token_ends(raw: np.ndarray) -> np.ndarray:
    """Code points before the end of each token; a token is a word with the white space before it, or white space at the end."""
    found, before = [], 0
    for a in range(0, len(raw), tx.PIECE_BYTES):
        own = raw[a : a + tx.PIECE_BYTES]
        inside = ~tx._SPACE[raw[a : a + tx.PIECE_BYTES + 1]]
        goes_on = np.zeros(len(own), bool)
        goes_on[: len(inside) - 1] = inside[1 : len(own) + 1]
        points = np.cumsum((own & 0xC0) != 0x80)
        found.append(before + points[np.flatnonzero(inside[: len(own)] & ~goes_on)])
        before += int(points[-1])
    if len(raw) and tx._SPACE[raw[-1]]:
        found.append(np.array([before]))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def encode(ends: np.ndarray) -> bytes:
    """Elias-Fano code of rising numbers: (count, low width, samples), low bits, high bits, places of sampled ones."""
    n = len(ends)
    if not n:
        return _HEAD.pack(0, 0, 0)
    width = max(0, (int(ends[-1]) // n).bit_length() - 1)
    low = np.packbits(((ends[:, None] >> np.arange(width)) & 1).astype(np.uint8)).tobytes() if width else b""
    ones = (ends >> width) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    return b"".join((_HEAD.pack(n, width, len(low)), low, ones[::SAMPLE].astype("<u8").tobytes(), np.packbits(high).tobytes()))


def select(code: bytes, k: int) -> int:
    """The k-th number of the code, from 0: reads its low bits and the high bits from one sample to the next."""
    n, width, size = _HEAD.unpack_from(code)
    at, low = _HEAD.size, 0
    if width:
        first = k * width
        bits = np.unpackbits(np.frombuffer(code, np.uint8, (first + width - 1) // 8 - first // 8 + 1, at + first // 8))[first % 8 : first % 8 + width]
        low = int(bits.astype(np.int64) @ (1 << np.arange(width)))
    at += size
    samples = -(-n // SAMPLE)
    start = struct.unpack_from("<Q", code, at + 8 * (k // SAMPLE))[0]
    high = at + 8 * samples
    stop = struct.unpack_from("<Q", code, at + 8 * (k // SAMPLE + 1))[0] + 1 if k // SAMPLE + 1 < samples else 8 * (len(code) - high)
    bits = np.unpackbits(np.frombuffer(code, np.uint8, (stop + 7) // 8 - start // 8, high + start // 8))
    bits[: start % 8] = 0
    one = start - start % 8 + int(np.flatnonzero(bits)[k % SAMPLE])
    return ((one - k) << width) | low


def boundaries(text: pa.Array) -> pa.Array:
    buf, o = tx.buffers(text)
    ends = [token_ends(buf[a:b]) for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([len(e) for e in ends], pa.int64()), pa.array([encode(e) for e in ends], pa.binary())], ["n", "code"])


def cuts(code: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """Code points before the first and the second cut, given as counts of tokens; null without a code."""
    out: list[list[int | None]] = [[], []]
    for c, ks in zip(code.to_pylist(), zip(first.to_pylist(), second.to_pylist(), strict=True), strict=True):
        for side, k in zip(out, ks, strict=True):
            side.append(None if c is None else select(c, k - 1) if k else 0)
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])


# --- index and join ---------------------------------------------------------------------------------


def text_index(docs: DataFrame) -> DataFrame:
    """(text, ids, n, code) for each distinct text, or for each salt of a hot one.

    A salt of a text that has over 1/4096 of the rows holds about as many of its documents.
    """
    rows = id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    per_salt = max(LEAST_SALT, -(-docs.count() // HOT_TEXTS))
    hot = rows.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > per_salt).select("h", F.ceil(F.col("c") / per_salt).cast("int").alias("salts"))
    # HOT_TEXTS rows at most, as each stands for over per_salt of all rows
    salt = F.coalesce(F.pmod(F.spark_partition_id(), F.col("salts")), F.lit(0)).alias("salt")
    groups = rows.join(F.broadcast(hot), "h", "left").select("h", salt, "text", "doc_id").groupBy("h", "salt", "text").agg(F.collect_list(F.struct("doc_id")).alias("ids"))
    return groups.select("text", "ids", F.arrow_udf(boundaries, "struct<n:long,code:binary>")("text").alias("x")).select("text", "ids", "x.n", "x.code")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of an id: the first groups of the SHA-256 of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs.

    n counts tokens. form is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle); fim_rate per cent of
    the texts are cut, and spm_rate per cent of those are spm. A text that is empty or holds a marker stays plain.
    """
    each = text_index(docs).select("text", "n", "code", F.explode("ids").alias("x")).select("text", "n", "code", "x.doc_id")
    h = draws(F.col("doc_id"), seed)
    whole = (F.col("text") == "") | F.col("text").rlike("|".join((PREFIX, SUFFIX, MIDDLE))) | (h[2] % 100 >= fim_rate)
    places = [x % (F.col("n") + 1) for x in h[:2]]
    rows = each.select("doc_id", "text", "n", "code", F.when(whole, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm").alias("form"), F.least(*places).alias("first"), F.greatest(*places).alias("second"))
    cut = rows.withColumn("cut", F.arrow_udf(cuts, "struct<a:long,b:long>")(F.when(F.col("form") != "plain", F.col("code")), "first", "second"))
    a, b = F.col("cut.a").cast("int"), F.col("cut.b").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.char_length("text"))
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return cut.select("doc_id", "n", "form", F.col("cut.a").alias("prefix_chars"), (F.col("cut.b") - F.col("cut.a")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Cut texts hold no marker, so the three markers part it."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)))
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def digests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """fill_in_middle with the SHA-256 of each output and of the text rebuilt from it."""
    made = fill_in_middle(docs, seed)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
