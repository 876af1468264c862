"""Time the headline queries: ``python bench.py`` prints one JSON line.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS`` the local
cores (default 8). Every query is written to the no-op sink, so the whole result is made.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "pseudobulk",
    "filter_cells",
    "feature_stats",
    "cis_pairs",
    "map_sites_to_genes",
    "standardize",
    "log_normalize",
    "equal_bins",
    "lead_variant",
    "bh_fdr",
    "quantile_normalize",
    "pearson_residuals",
    "biallelic_summary",
    "one_site_per_gene",
    "sum_by_bin_line_min",
    "knn",
    "knn_boost",
    "grouped_ols",
    "regress_out",
    "bootstrap_stability",
    "grouped_lmm",
    "pca",
    "eqtl_als",
    "eqtl_vi",
    "call_cis_eqtls",
]
# the fits are timed over three iterations, whatever the tables
TIMED_AS = {"eqtl_als": "eqtl_als_three_steps", "eqtl_vi": "eqtl_vi_three_steps"}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("varloom-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from checks import QUERIES

    QUERIES["library_size"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[TIMED_AS.get(name, name)](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
