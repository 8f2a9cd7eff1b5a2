"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   data folder, default /root/testdata/sf0.1
BENCH_CPUS     local cores, default 8
BENCH_QUERIES  comma-separated names, or "all"
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cultiva.session import configure  # noqa: E402
from suite import REGISTRY  # noqa: E402

HEADLINE = [
    "popularity_recommender_topk",
    "taxonomy_recommender_topk",
    "popularity_auc_per_medium",
    "auc_per_medium",
    "label_matrix_dense",
    "heldout_manifest",
    "top_media_wide",
    "topk_metrics_from_scores",
    "strain_medium_features",
    "extract_phenotypes",
    "strain_media_links",
    "parse_isolation",
    "tetra_frequencies",
    "codon_frequencies",
    "mean_isoelectric_point",
    "genome_features",
    "marker_summary",
    "marker_pivot",
    "module_completeness",
    "mean_pool",
    "pool_per_category",
    "merge_label_sources",
    "fuse_features",
    "describe_target_by_type",
    "spearman",
    "class_separation",
    "catalog_rows",
    "shortest_per_category",
    "one_hot_tags",
    "chunk_names",
    "cross_validate_regression",
    "production_models_top_media",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark, tempfile.mkdtemp(prefix="bench-"))
    spark.read.parquet(f"{folder}/nation.parquet").count()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{seconds[name]:8.2f}s {name}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
