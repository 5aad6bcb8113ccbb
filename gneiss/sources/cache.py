"""Datasets kept in memory by name, and result documents that know which data they were made of."""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators.predicates import column


def plan_size(df: DataFrame) -> int:
    """Bytes that Spark's plan statistics expect of a table, before it is read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's columns and rows that neither order nor partitions change, in one aggregation.

    Rows are hashed twice, to 64 bits each, and the hashes added up, so repeated rows count. Nulls are told from
    empty values; values of a kind that can't be hashed (maps, variants) count by their JSON text.
    """
    parts = []
    for f in df.schema:
        c = column(f.name)
        c = F.to_json(F.struct(c.alias("v"))) if _unhashed(f.dataType) else c
        parts += [c, c.isNull()]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)"))
    r = df.agg(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b")).first()
    kinds = json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema])
    text = f"{kinds}|{r['n']}|{int(r['a'] or 0) % 2**64:016x}{int(r['b'] or 0) % 2**64:016x}"
    return hashlib.sha256(text.encode()).hexdigest()


def _unhashed(kind: T.DataType) -> bool:
    if isinstance(kind, (T.MapType, T.VariantType)):
        return True
    if isinstance(kind, T.ArrayType):
        return _unhashed(kind.elementType)
    return isinstance(kind, T.StructType) and any(_unhashed(f.dataType) for f in kind)


def snapshot(df: DataFrame) -> tuple | None:
    """(file, length, time of change) of the files that a table is read from, from their file system; null for one without files."""
    spark = df.sparkSession
    names = df.inputFiles()
    if not names:
        return None
    conf, out = spark._jsparkSession.sessionState().newHadoopConf(), []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))


class Version:
    """The fingerprint of a table, made anew only where its files' lengths or times have changed."""

    def __init__(self, df: DataFrame):
        self.df = df
        self._seen: tuple | None = None
        self._print: str | None = None

    def current(self) -> str:
        now = snapshot(self.df)
        if self._print is None or now != self._seen:
            self._seen, self._print = now, fingerprint(self.df)
        return self._print


class DatasetCache:
    """Tables by name, persisted, the least recently used unpersisted when all together pass `capacity` bytes.

    Sizes are the plan's estimates when a table enters. A table over the whole capacity is not kept and comes back as it is.
    """

    def __init__(self, capacity: int = 8 << 30, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.capacity, self.level = capacity, level
        self._kept: OrderedDict[str, tuple[DataFrame, int]] = OrderedDict()

    def __contains__(self, name: str) -> bool:
        return name in self._kept

    def __len__(self) -> int:
        return len(self._kept)

    @property
    def size(self) -> int:
        return sum(s for _, s in self._kept.values())

    def names(self) -> list[str]:
        """Least recently used first."""
        return list(self._kept)

    def insert(self, name: str, df: DataFrame) -> DataFrame:
        """Keep a table under a name, in place of one that has it."""
        self.remove(name)
        size = plan_size(df)
        if size > self.capacity:
            return df
        while self._kept and self.size + size > self.capacity:
            self.remove(next(iter(self._kept)))
        self._kept[name] = (df.persist(self.level), size)
        return df

    def get(self, name: str) -> DataFrame | None:
        if name not in self._kept:
            return None
        self._kept.move_to_end(name)
        return self._kept[name][0]

    def get_or_insert(self, name: str, make) -> DataFrame:
        return got if (got := self.get(name)) is not None else self.insert(name, make())

    def remove(self, name: str) -> bool:
        if name not in self._kept:
            return False
        self._kept.pop(name)[0].unpersist()
        return True

    def clear(self) -> None:
        for name in self.names():
            self.remove(name)


class ResultCache:
    """Result documents by their query and the data's version; a new one replaces the old.

    A document of another version of the same query is stale: get() passes over it and put() drops it.
    """

    def __init__(self) -> None:
        self._kept: dict[str, tuple[str | None, object]] = {}

    @staticmethod
    def key(*query) -> str:
        return json.dumps(query, sort_keys=True, default=lambda x: dict(x) if isinstance(x, Mapping) else str(x))

    def get(self, *query, version: str | None = None):
        kept = self._kept.get(self.key(*query))
        return kept[1] if kept and kept[0] == version else None

    def put(self, document, *query, version: str | None = None) -> None:
        self._kept[self.key(*query)] = (version, document)

    def drop(self, *query) -> None:
        self._kept.pop(self.key(*query), None)

    def __len__(self) -> int:
        return len(self._kept)
