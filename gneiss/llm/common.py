"""Shared folder, intermediate tables and id digests used by the text operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
_written: dict[str, SparkSession] = {}  # tables that are there still


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode alone, a temporary one stands in where none is set."""
    path = spark.conf.get(CHECKPOINT_CONF, None) or getattr(spark, "_gneiss_dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
        path = spark._gneiss_dir = tempfile.mkdtemp(prefix="gneiss-")
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts its lineage.

    parts: as many tasks at most write it, for results whose row count is known to be small for more.
    """
    spark = df.sparkSession
    if parts:
        df = df.coalesce(parts)
    path = f"{shared_dir(spark)}/gneiss-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gneiss_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    _written.pop(path, None)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that materialize() wrote, once nothing lazy reads them any more."""
    for df in tables:
        if path := getattr(df, "_gneiss_path", None):
            _delete(df.sparkSession, path)


def release() -> int:
    """Delete all tables that are left, those that results read lazily among them; how many. Also runs as the driver ends."""
    left = list(_written.items())
    for path, spark in left:
        _delete(spark, path)
    return len(left)


def _at_exit() -> None:
    try:
        release()
    except (Py4JError, OSError):  # Spark is gone already, and its folder with it or not
        pass


atexit.register(_at_exit)


def digest_mod(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(m)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def next_pow2(n: float, least: int = 1) -> int:
    p = least
    while p < n:
        p *= 2
    return p
