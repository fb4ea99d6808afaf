"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).  A query's time covers building its
plan, including what it writes on the way, and computing all result rows; results are discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import QUERIES  # noqa: E402
from tidemark.session import configure  # noqa: E402

HEADLINE = [
    "entity_read_basic",
    "entity_read_comparisons",
    "entity_page",
    "entity_count",
    "approval_view",
    "edge_view",
    "merge_upsert",
    "merge_upsert_small_batch",
    "merge_key_only",
    "merge_counters",
    "delete_by_key",
    "soft_delete",
    "apply_changes",
    "reconcile_deletes",
    "reconcile_soft_deletes",
    "deletion_guard",
    "full_sync",
    "full_sync_soft",
    "delta_sync",
    "delta_sync_small_batch",
    "latest_per_key",
    "delta_gt",
    "classify_changes",
    "audit_columns",
    "profile_lineitem",
    "profile_documents",
    "profile_events_bag",
    "inherited_factor",
    "with_inherited",
    "reachable",
    "create_transactions",
    "successors",
    "check_unique",
    "check_references",
    "extract_tags",
    "decode_attributes",
    "assemble_records",
    "collect_ranges",
    "parse_repl_metadata",
    "plan_directory_changes",
    "read_pages",
    "stream_upsert",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    run("merge_upsert")  # start the JVM's compilers before anything is timed
    seconds = {name: round(run(name), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
