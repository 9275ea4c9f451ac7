"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line. A query's rows are all computed, and not kept."""

from __future__ import annotations

import json
import os
import time

from tessera import catalog
from tessera.session import session

HEADLINE = (
    "dedup_sources",
    "exact_dedup_heads",
    "clean_response",
    "cascade",
    "refusal_rollup",
    "coverage_report",
    "trajectories",
    "gt_match",
    "recall_per_run",
    "roc",
    "win_count",
    "elo",
    "stratified_sample",
    "stub_answers",
    "stream_dedup",
    "event_sessions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session("bench", f"local[{cpus}]", spark__driver__memory="12g", spark__sql__shuffle__partitions=str(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
