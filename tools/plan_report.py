"""Physical-plan summary of every registered query (nothing is executed
except queries that write tables, which are skipped): parquet scans,
shuffles, broadcasts, partial window limits and pushed filters.

usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Queries that write tables or run a stream while being built.
WRITES = {"export_csv", "result_store_replace", "append_log", "reset_keys", "share_back", "share_back_counts",
          "incremental_ingest", "feed_bundle_status", "readings_table"}


def summarise(text: str) -> dict:
    def nodes(name: str) -> int:
        return len(re.findall(r"^\(\d+\) " + re.escape(name) + r"\s*$", text, re.M))
    return {
        "scans": nodes("Scan parquet"),
        "shuffles": nodes("Exchange"),
        "broadcasts": nodes("BroadcastExchange"),
        "partial_limits": nodes("WindowGroupLimit") // 2,
        "windows": nodes("Window"),
        "ts_pushdown": "yes" if re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\((ts|o_orderdate)", text) else "",
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from histospark.plans.registry import QUERIES
    from histospark.session import get_session
    spark = get_session()
    print("# Physical plans (initial adaptive plans, sf = %s)\n" % os.path.basename(sf_dir))
    print("Generated by `tools/plan_report.py`. *scans* = parquet scans, *shuffles* = exchanges other than "
          "broadcasts, *partial_limits* = per-key top-k applied before the shuffle, *ts_pushdown* = a time "
          "predicate reached the parquet scan. Queries that write tables are listed without a plan.\n")
    print("| query | scans | shuffles | broadcasts | windows | partial_limits | ts_pushdown |")
    print("|---|---|---|---|---|---|---|")
    for name, fn in sorted(QUERIES.items()):
        if name in WRITES:
            print(f"| {name} | (writes a table) | | | | | |")
            continue
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            fn(spark, sf_dir).explain("formatted")
        s = summarise(buf.getvalue())
        print(f"| {name} | {s['scans']} | {s['shuffles']} | {s['broadcasts']} | {s['windows']} | "
              f"{s['partial_limits']} | {s['ts_pushdown']} |")


if __name__ == "__main__":
    main()
