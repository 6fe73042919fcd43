"""Time the headline queries: one JSON line on stdout.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "list_posts", "list_posts_filtered", "reindex", "mark_duplicates", "label_posts", "join_latest_run", "search_posts",
    "normalize_archive_post", "merge_versions", "union_seeds", "upsert_table", "skip_existing_import", "take_until", "page_progress",
    "scan_feed_pages", "normalize_feed_post", "scan_stats_payloads", "reconcile_status", "resolve_run", "assemble_log",
    "series_to_points", "check_offsets", "day_summary", "rank_output", "refresh_marker_block", "extract_html_rows",
]

LONG = 8.0


def main() -> None:
    from pyspark.sql import SparkSession

    from workload import load

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("FATAL")
    queries, _ = load()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads before timing
    times = {}
    for name in HEADLINE:
        best = None
        # A second run shows the time without code generation; long queries are run once.
        while best is None or (runs < 2 and best < LONG):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best, runs = (took, 1) if best is None else (min(best, took), runs + 1)
        times[name] = round(best, 3)
        print(f"{name} {best:.2f}s", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
