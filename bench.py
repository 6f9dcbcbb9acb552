"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from convoy.plans import load_all
from convoy.plans.registry import ENTRIES
from convoy.session import build_session

HEADLINE = [
    "dedup_first_arrival", "seq_guard", "twin_latest", "rules_threshold", "rules_element", "hop_min", "cep_pairs",
    "alerts_all", "alert_enrich", "daily_rollup", "rollup_incremental", "features_daily", "feature_table",
    "lead_time", "average_precision", "precision_at_k", "reconcile_keys", "quarantine_counts", "latest_risk",
    "at_risk_page", "board_scheduled", "work_order_state", "nearest_depot", "nearest_depot_cells", "geohash_mask",
    "hash_embed", "kb_search", "knn_dense",
]
REPEATS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = build_session(
        "convoy-bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(REPEATS):
            begin = time.perf_counter()
            ENTRIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        seconds[name] = round(min(times), 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1],
        "events": events, "rows_per_sec": {n: round(events / seconds[n]) for n in ("dedup_first_arrival", "feature_table", "alerts_all", "daily_rollup")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
