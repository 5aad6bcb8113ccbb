"""Delimited files: field counts, dialects and encodings, against Python's csv module."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from gneiss import queries
from gneiss.plans.specs import make
from gneiss.session import Engine
from gneiss.sources import cache, encoding, readers

TEXTS = {
    "UTF-8": "naïve, 日本, Привет",
    "UTF-16LE": "plain text, été",
    "UTF-16BE": "plain text, été",
    "GB18030": "今天天气很好，我们一起去公园散步。他说这个国家的人民生活得很幸福，因为有和平与发展。",
    "Big5": "今天天氣很好，我們一起去公園散步。他說這個國家的人民生活得很幸福，因為有和平與發展。",
    "Shift_JIS": "今日はとても良い天気ですので、公園へ散歩に行きましょう。ソフト表",
    "EUC-JP": "今日はとても良い天気ですので、公園へ散歩に行きましょう。",
    "EUC-KR": "오늘은 날씨가 매우 좋아서 공원으로 산책을 갑니다.",
    "windows-1251": "Сегодня очень хорошая погода, и мы пойдём гулять в парк.",
    "KOI8-R": "Сегодня очень хорошая погода, и мы пойдем гулять в парк.",
    "windows-1250": "Dziś jest bardzo ładna pogoda, więc pójdziemy na spacer. Příliš žluťoučký kůň.",
    "windows-1252": "Aujourd’hui il fait très beau, nous irons près du théâtre où l’été arrive.",
    "windows-1253": "Σήμερα ο καιρός είναι πολύ καλός και θα πάμε βόλτα στο πάρκο.",
    "windows-1254": "Bugün hava çok güzel, parka yürüyüşe gideceğiz. İsim, şehir, yaş, ışık.",
    "windows-1255": "היום מזג האוויר נאה מאוד ואנחנו נלך לטייל בפארק.",
    "windows-1256": "الطقس جميل جدا اليوم وسوف نذهب للتنزه في الحديقة",
}


@pytest.mark.parametrize("name", TEXTS)
def test_encoding_is_recognised_and_read(spark, tmp_path, name):
    bare = "".join(c for c in TEXTS[name] if c.isalpha() or c == " ")
    assert encoding.detect(bare.encode(name) * 50) == name
    rows = [(str(i), f"{TEXTS[name]} {i}") for i in range(40)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([("id", "text"), *rows])
    raw = out.getvalue().encode(name)
    assert encoding.detect(raw) == name
    assert encoding.detect((raw * 200)[: 1 << 16], whole=False) == name  # cut inside a character
    (tmp_path / "t.csv").write_bytes(raw)
    got = readers.read(spark, f"file://{tmp_path}/t.csv")
    assert got.columns == ["id", "text"]
    assert sorted(map(tuple, got.collect())) == sorted(rows)


@pytest.mark.parametrize("quote_escape", ['"', "\\"])
def test_field_count_equals_a_csv_reader(spark, quote_escape):
    rng = random.Random(3)
    lines = ["", ",", '"a,b",c', '"a""b",c', '"a', 'a"b,c', '"x"y,z', ",,,"]
    if quote_escape == '"':
        lines += ["".join(rng.choice('ab,"') for _ in range(rng.randint(0, 12))) for _ in range(300)]
    else:
        lines = ['"a\\",b",c', '"a\\\\",c', "a,b", '"a,b",c', '""']
    d = readers.Dialect(escape=quote_escape)
    got = spark.createDataFrame([(x,) for x in lines], "raw string").select("raw", readers.field_count(F.col("raw"), d).alias("n")).collect()
    options = {"doublequote": True} if quote_escape == '"' else {"doublequote": False, "escapechar": "\\"}
    for r in got:
        want = next(csv.reader([r["raw"]], **options), None)
        assert r["n"] == max(1, len(want or [])), r


def test_long_records_go_and_short_ones_are_filled(spark, tmp_path):
    lines = ["a,b,c", "1,2,3", "4,5", "6", '"7,7","8 ""x""",9', "1,2,3,4", "1,2,3,", "1,2,3,,", "1,2,3,,,,5", '"1,1",2,3,"4,4"', '"1,1",2,3,,"4"', '"x,y","z,w","v,u"', "10,,"]
    (tmp_path / "r.csv").write_text("\n".join(lines) + "\n")
    got = sorted(tuple(r) for r in readers.read_delimited(spark, f"file://{tmp_path}/r.csv", readers.Dialect()).fillna("-").collect())
    assert got == sorted([("1", "2", "3"), ("4", "5", "-"), ("6", "-", "-"), ("7,7", '8 "x"', "9"), ("x,y", "z,w", "v,u"), ("10", "-", "-")])


def test_line_ends_inside_quotes(spark, tmp_path):
    rows = [("id", "text"), *((str(i), f"line {i}\nand, more") for i in range(20))]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    (tmp_path / "m.csv").write_text(out.getvalue())
    assert readers.sniff(out.getvalue().encode()).multiline
    assert sorted(map(tuple, readers.read(spark, f"file://{tmp_path}/m.csv").collect())) == sorted(rows[1:])
    assert not readers.sniff(b'a,b\n1,"2"\n3,"4"\n').multiline


def test_pruned_columns_keep_the_same_records(spark, tmp_path):
    (tmp_path / "p.csv").write_text('a,b,c\n1,2,3\n4\n5,6,7,8\n"x,y",2,3\n1,2,3,\n')
    df = readers.read(spark, f"file://{tmp_path}/p.csv")
    assert df.count() == 3 and df.select("a").count() == 3 and df.limit(2).count() == 2
    assert sorted(r[0] for r in df.select("a").collect()) == ["1", "4", "x,y"]


def test_fingerprint_and_results_follow_the_data(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(1, "a", {"k": 1}), (2, None, None), (2, None, None)], "x int, s string, m map<string,int>").write.parquet(path)
    df = spark.read.parquet(path)
    assert cache.fingerprint(df) == cache.fingerprint(df.repartition(3)) != cache.fingerprint(df.limit(2))
    assert cache.fingerprint(df.select("x")) != cache.fingerprint(df.select(F.col("x").cast("long")))
    assert cache.snapshot(spark.range(3)) is None and len(cache.snapshot(df)) >= 1
    version = cache.Version(df)
    first = version.current()
    assert version.current() == first
    kept = cache.ResultCache()
    kept.put([1], "spec", {"b": 1, "a": 2}, version=first)
    assert kept.get("spec", {"a": 2, "b": 1}, version=first) == [1]
    spark.createDataFrame([(3, "c", None)], "x int, s string, m map<string,int>").write.mode("overwrite").parquet(path)
    again = cache.Version(spark.read.parquet(path)).current()
    assert again != first and kept.get("spec", {"a": 2, "b": 1}, version=again) is None
    kept.put([2], "spec", {"b": 1, "a": 2}, version=again)
    assert len(kept) == 1


def test_dataset_cache_evicts_the_least_recently_used(spark):
    make = lambda n: spark.range(n).selectExpr("id", "id * 2 as twice")
    size = cache.plan_size(make(1000))
    kept = cache.DatasetCache(capacity=2 * size + size // 2)
    a = kept.insert("a", make(1000))
    kept.insert("b", make(1000))
    assert kept.get("a") is a and a.is_cached and kept.names() == ["b", "a"]
    kept.insert("c", make(1000))
    assert kept.names() == ["a", "c"] and "b" not in kept and kept.get("b") is None and kept.size == 2 * size
    big = kept.insert("d", make(10**7))
    assert not big.is_cached and "d" not in kept
    assert kept.get_or_insert("c", lambda: pytest.fail("is kept")) is kept.get("c")
    assert kept.remove("a") and not kept.remove("a") and not a.is_cached
    kept.clear()
    assert len(kept) == 0


def test_engine_reads_a_path_once_and_results_follow_the_file(spark, tmp_path):
    path, engine = f"file://{tmp_path}/e.csv", Engine(spark)
    (tmp_path / "e.csv").write_text("g,v\na,1\nb,2\nb,3\n")
    spec = make("val:count", "c", ("bar",), "", field_a="g")
    assert engine.read(path).df is engine.read(path).df
    assert [tuple(r) for r in engine.read(path).visualize(spec)] == [("b", 2), ("a", 1)]
    (tmp_path / "e.csv").write_text("g,v\na,1\n")
    assert engine.forget(path)
    assert [tuple(r) for r in engine.read(path).visualize(spec)] == [("a", 1)]
    engine.datasets.clear()


def test_encoding_of_a_folder_whose_first_task_was_empty(spark, tmp_path):
    """Its file holds the ASCII header alone, and used to be taken for UTF-8."""
    path, text = str(tmp_path / "t.csv"), TEXTS["windows-1251"]
    line = F.concat(F.col("id").cast("string"), F.lit(";" + text.encode("windows-1251").decode("latin-1")))
    spark.range(0, 40, 1, 4).where("id >= 10").select(line.alias("id;text")).write.option("header", True).option("encoding", "ISO-8859-1").option("sep", "\u0001").csv(path)
    assert min(f.stat().st_size for f in (tmp_path / "t.csv").glob("part-*")) == len("id;text\n")
    assert sorted(map(tuple, readers.read(spark, path).collect())) == sorted((str(i), text) for i in range(10, 40))


@pytest.mark.parametrize("name", ["windows-1251", "Shift_JIS", "UTF-8"])
def test_encoding_is_told_by_lines_behind_the_first_bytes(spark, tmp_path, name):
    path, text = tmp_path / "late.csv", TEXTS[name].replace(",", " ")
    plain = [f"{i},plain" for i in range(100_000)]
    path.write_bytes("\n".join(["id,text", *plain, f"x,{text}", f"y,{text * 200}", ""]).encode(name))
    assert readers.prefix(spark, str(path)).isascii()
    got = {r["id"]: r["text"] for r in readers.read(spark, str(path)).where("id in ('x', 'y', '7')").collect()}
    assert got == {"7": "plain", "x": text, "y": text * 200}


def test_long_rows_are_written_by_every_task(spark, tmp_path, monkeypatch):
    """One task used to sort and write all lines, so its memory grew with the table."""
    orders = spark.range(0, 400, 1, 4).select(F.col("id").alias("o_orderkey"), (F.col("id") * 1.25).alias("o_totalprice"), F.lit("1-URGENT").alias("o_orderpriority"))
    monkeypatch.setattr(queries, "read", lambda *_: orders)
    monkeypatch.setattr(queries, "shared_folder", lambda _: str(tmp_path / "long"))
    got = {r["o_orderkey"] for r in queries.csv_long_rows(spark, "").collect()}
    assert got == {k for k in range(400) if k % 9 > 2}
    written = [f.read_text().splitlines() for f in (tmp_path / "long.csv").glob("part-*")]
    assert [len(w) for w in written] == [101] * 4 and {w[0] for w in written} == {"o_orderkey,o_totalprice,o_orderpriority"}
