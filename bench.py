"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "exact_duplicate_groups", "near_duplicate_pairs", "item_filter_compound", "plain_search", "sort_source", "item_page_two", "lookup_by_ids",
    "tag_counts", "folder_counts", "number_gaps", "missing_in_range", "numbering_restart", "best_cut", "stem_runs", "block_formation",
    "pairs_by_coordinate", "pairs_by_chosen_mode", "duplicate_numbers", "declared_count_mismatch", "long_blocks", "lost_content",
    "option_anomalies", "item_audit", "load_plan", "refresh_violations", "asset_summary", "fused_readings", "contained_owners",
    "numbered_by_type", "stratified_sample", "normalized_blocks", "import_gate", "batch_overview", "stream_latest_state",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from itemloom.registry import QUERIES
    from itemloom.session import build_session
    import itemloom.queries  # noqa: F401

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g", "spark.ui.enabled": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").split("sf")[-1]}))


main()
