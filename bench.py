"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local cores.
Every query is run to its last row; results are dropped. Silver tables are built
once, as timed steps of their own.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from trialmart.plans import catalog  # noqa: E402

HEADLINE = (
    "conform_orders",
    "orders_silver",
    "users_from_raw",
    "fact_join",
    "user_aggregates",
    "enrich_orders",
    "ab_summary",
    "ab_robust",
    "ab_robust_exact",
    "rfm_scores",
    "ab_by_all_segments",
    "robust_by_rfm",
    "ab_tests_pvalues",
    "nonparam_tests_pvalues",
    "nonparam_by_rfm",
    "winsorize_global",
    "financial_viability",
    "break_even_platform",
    "projection_excluding_neg",
    "boxplot_ab",
    "hist_ab",
    "dq_null_counts",
    "dq_duplicate_members",
    "governance_checkpoint",
)
STAGES = {
    "stage_orders_silver": catalog.silver_orders,
    "stage_users_silver": catalog.silver_users,
    "stage_users_rfm": catalog.scored_users,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trialmart-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds: dict[str, float] = {}

    def timed(name, action) -> None:
        start = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - start, 3)

    for name, stage in STAGES.items():
        timed(name, lambda: stage(spark, sf_dir))
    for name in HEADLINE:
        query = catalog.queries()[name]
        timed(name, lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
