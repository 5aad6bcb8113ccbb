"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from gneiss.operators import groupings
from gneiss.plans.compile import compile_batch
from gneiss.plans.enumerate import enumerate_specs
from gneiss.profile.describe import profile
from gneiss.queries import QUERIES

HEADLINE = (
    "val_agg_mean_ci", "agg_fns_by_flag", "val_box", "val_count_topk", "multigroup_agg_mean_ci", "bin_agg_count", "crosstab2_cube", "join_outer", "unpivot_lineitem", "filter_and_or",
    "uniqueness", "describe_numeric", "infer_types", "hierarchy_pairs", "correlation_matrix", "kruskal_h", "ks_2samp_d", "levene_stat", "ols_multi", "anova_twoway", "r2_contribution", "score_specs",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lineitem.count()
    times: dict[str, float] = {}

    def timed(name: str, f) -> None:
        start = time.perf_counter()
        f()
        times[name] = round(time.perf_counter() - start, 3)

    for name in HEADLINE:
        timed(name, lambda name=name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    fields: list = []
    timed("profile_lineitem", lambda: fields.extend(profile(lineitem)))
    specs = [s for s in enumerate_specs(fields, ["l_returnflag", "l_quantity", "l_extendedprice"]) if s.procedure == "val:agg"]
    timed("spec_batch_fused", lambda: [d.collect() for d in compile_batch(specs, lineitem).values()])
    spark.catalog.clearCache()
    timed("spec_batch_unfused", lambda: [groupings.value_aggregate(lineitem, s.arg("grouped_field"), s.arg("agg_field"), s.arg("agg_fn")).collect() for s in specs])
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
