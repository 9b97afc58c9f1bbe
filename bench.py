"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``queries`` holds the second run of each query, ``first_runs`` the first.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from ferrywork.plans.registry import load_checks  # noqa: E402
from ferrywork.plans.sync import STATS  # noqa: E402
from ferrywork.plans.sync_queries import MOMENTS, run_cycles  # noqa: E402
from ferrywork.session import build_session  # noqa: E402

HEADLINE = [
    "sync_slice", "sync_cycle", "sync_cycle_raw", "scan_incremental", "scan_batch_limited", "scan_soft_deletes", "t_chain", "t_filter",
    "t_cast_int", "t_script_udtf", "x_arith", "x_string_methods", "load_raw", "raw_replay", "raw_hash_dedup", "merge_upsert",
    "load_insert_ignore", "delete_by_pk", "compact_latest", "bookmark_upsert", "dead_letter_split", "quality_log", "quality_unique_check",
    "dashboard_summary", "pipeline_overview", "dependency_gate", "runs_by_asset", "runs_page_per_pipeline", "daily_run_stats",
    "lineage_assets", "alert_routing", "stream_sync_append", "scan_batch_cut", "runs_deep_page", "infer_document_types", "dead_letter_reprocess_load",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    work = tempfile.mkdtemp(prefix="bench-")
    conf = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.warehouse.dir": f"{work}/warehouse",
        "spark.checkpoint.dir": f"{work}/shared",
    }
    spark = build_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    checks, seconds, first = load_checks(), {}, {}
    for key in HEADLINE:
        # The first run also loads classes and compiles code; it is reported apart.
        for timings in (first, seconds):
            start = time.perf_counter()
            checks[key].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[key] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    ws, _ = run_cycles(spark, sf_dir, MOMENTS)
    took = time.perf_counter() - start
    moved = ws.read_log("run_table_stats", STATS).selectExpr("sum(rows_extracted) AS extracted", "sum(rows_loaded_analytics) AS loaded").first()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    result = {
        "metric": "total time of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "first_runs": first,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        # One merge of the whole table, planned but not written.
        "slice_rows_per_min": round(orders / seconds["sync_slice"] * 60),
        # Three full cycles with state, log and dead letters: rows read past the bookmark, and rows that came to the target.
        "cycle_extracted_rows_per_min": round(moved["extracted"] / took * 60),
        "cycle_loaded_rows_per_min": round(moved["loaded"] / took * 60),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
