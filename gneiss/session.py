"""Facade: a dataset with its profile, recommendations and statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from gneiss.operators import transform
from gneiss.operators.crosstab import run_aggregation
from gneiss.plans.compile import compile_spec
from gneiss.plans.enumerate import enumerate_specs
from gneiss.plans.score import recommend
from gneiss.plans.specs import VizSpec, canonical
from gneiss.profile.describe import Field, override, profile
from gneiss.profile.relations import hierarchies
from gneiss.sources import readers
from gneiss.sources.cache import DatasetCache, ResultCache, Version
from gneiss.sources.sinks import write_table
from gneiss.stats import comparison, correlation, regression


class Dataset:
    def __init__(self, df: DataFrame, cache: ResultCache | None = None):
        self.df = df
        self.results = ResultCache() if cache is None else cache
        self.version = Version(df)

    @cached_property
    def fields(self) -> list[Field]:
        return profile(self.df)

    def override(self, name: str, type: str | None = None, id: bool | None = None) -> None:
        self.fields = override(self.fields, name, type, id)

    def hierarchies(self) -> dict[str, dict[str, list[str]]]:
        return hierarchies(self.df, [f.name for f in self.fields if f.general == "c" and not f.unique])

    def reduce(self, positions: Sequence[int]) -> Dataset:
        return Dataset(transform.reduce_columns(self.df, positions))

    def unpivot(self, fields: Sequence[str], variable: str = "variable", value: str = "value") -> Dataset:
        return Dataset(transform.unpivot(self.df, fields, variable, value))

    def join(self, other: Dataset, **how) -> Dataset:
        return Dataset(transform.join(self.df, other.df, **how))

    def recommend(self, selected: Sequence[str] = (), kinds: Sequence[str] = ("exact", "subset", "baseline", "expanded"), conditionals: Mapping | None = None, limit: int | None = None):
        return recommend(self.df, enumerate_specs(self.fields, selected, kinds, limit), selected, conditionals)

    def visualize(self, spec: VizSpec, conditionals: Mapping | None = None, config: Mapping | None = None) -> list:
        """A spec's result rows: the kept ones, unless the spec, its settings or the data have changed."""
        key, version = canonical(spec, conditionals, config), self.version.current()
        if (got := self.results.get(key, version=version)) is None:
            got = compile_spec(spec, self.df, conditionals, config).collect()
            self.results.put(got, key, version=version)
        return got

    def aggregate(self, variables: Sequence[str], dependent: str | None = None, **options) -> DataFrame | None:
        return run_aggregation(self.df, variables, dependent, **options)

    def correlate(self, fields: Sequence[str], conditionals: Mapping | None = None):
        return correlation.correlate(self.df, fields, conditionals)

    def compare(self, dependents: Sequence[str], independents: Sequence[str], independent: bool = True) -> dict:
        match comparison.comparison_kind(dependents, independents):
            case "anova":
                samples = comparison.long_samples(self.df, independents[0], dependents[0])
                return {"anova": regression.anova(self.df, dependents[0], independents) if len(dependents) == 1 else [], "pairwise": comparison.tukey(samples)}
            case "numeric":
                return {"tests": comparison.compare_columns(self.df, list(dependents) or list(independents), independent)}
        return {}

    def regress(self, dependent: str, independents: Sequence[str] | None = None, **options):
        chosen = independents or [f.name for f in self.fields if f.name != dependent and not (f.general == "c" and f.unique) and f.general != "t"]
        return regression.regress(self.df, dependent, chosen, **options)

    def recommend_model(self, dependent: str, kind: str = "forwardR2") -> list[str]:
        return regression.recommend_model(self.df, dependent, [f.name for f in self.fields if not f.id and f.general != "t"], kind)

    def save(self, path: str, kind: str = "parquet") -> None:
        write_table(self.df, path, kind)


class Engine:
    """Datasets of one session. Tables that are read by path are kept in memory, the least recently used going first."""

    def __init__(self, spark: SparkSession, capacity: int = 8 << 30):
        self.spark = spark
        self.datasets = DatasetCache(capacity)
        self.results: dict[str, ResultCache] = {}

    def read(self, path: str) -> Dataset:
        return Dataset(self.datasets.get_or_insert(path, lambda: readers.ingest(self.spark, path)), self.results.setdefault(path, ResultCache()))

    def forget(self, path: str) -> bool:
        """Drop a table and free its memory, so that it is read anew; results of unchanged data stay valid."""
        return self.datasets.remove(path)

    def dataset(self, df: DataFrame) -> Dataset:
        return Dataset(df)
