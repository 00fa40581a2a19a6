"""Benchmark: run the headline catalogue queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_QUERIES (comma list, default: the headline set),
BENCH_REPEAT (default 3 timed runs per query after one untimed warm-up
query; the best run is reported, the median beside it).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from vigilspark.plans.catalogue import QUERIES  # noqa: E402
from vigilspark.session import get_session  # noqa: E402

HEADLINE = [
    "alert_pipeline", "pattern_watch_alerts", "correlation_alerts", "triage_alerts",
    "keyword_stats", "slot_baseline", "anomaly_online", "anomaly_scored",
    "aggregate_rollup", "boot_window_stats", "window_hit_count", "pattern_reset",
    "capped_buffer", "journal_parse", "journal_alerts", "line_keyword_hits", "flag_counts",
    "correlation_span_alerts", "correlation_three_sources", "dedup_rerun", "status_report",
    "rules_table_hits", "anomaly_two_parts",
]


def _run(df) -> int:
    # a full evaluation without shipping rows to the driver
    return df.write.format("noop").mode("overwrite").save() or 0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus))
    # untimed JVM / Python-worker warm-up so the first timed query is not
    # charged for start-up
    _run(QUERIES["alert_pipeline"](spark, sf_dir))
    times, medians = {}, {}
    for name in names:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            _run(QUERIES[name](spark, sf_dir))
            runs.append(time.perf_counter() - t0)
        times[name], medians[name] = round(min(runs), 3), round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "catalogue_total_warm_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "median": medians,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
