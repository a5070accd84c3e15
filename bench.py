"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs 3 times in a warm session (median reported); every run
executes the full plan into the ``noop`` sink, so nothing is collected on the
driver. ``init_metadata`` times stream discovery from scratch (new context,
distinct-Field job, metadata table written and read back), warm. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["detect_anomalies", "forecast_signal", "unified_readings", "hourly_trend", "signal_stats",
            "redact_text", "rolling_stats", "reading_gaps", "holt_fit", "latest_reading", "feed_volume",
            "data_dictionary", "redaction_counts", "anomaly_candidates", "trend_summary"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE
    from histospark.context import Historian
    from histospark.plans.registry import QUERIES
    from histospark.session import get_session
    from histospark.sources.fixtures import fixture_feeds
    spark = get_session(cpus=cpus, shuffle_partitions=int(cpus))

    inits = []
    for _ in range(2):  # the first run pays JVM / codegen warm-up; the warm one is reported
        t0 = time.perf_counter()
        fresh = Historian(spark, fixture_feeds(spark, sf_dir), sf_dir=sf_dir)
        _ = fresh.metadata_rows
        inits.append(time.perf_counter() - t0)
    init = inits[-1]

    results = {"init_metadata": round(init, 3)}
    for name in names:
        fn = QUERIES[name]
        run(fn(spark, sf_dir))  # warm-up (also warms the per-session metadata)
        times = []
        for _ in range(repeats):
            t = time.perf_counter()
            run(fn(spark, sf_dir))
            times.append(time.perf_counter() - t)
        results[name] = round(statistics.median(times), 3)
    total = round(sum(v for k, v in results.items()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": total, "unit": "sec",
                      "queries": results, "sf": sf, "cpus": cpus, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
