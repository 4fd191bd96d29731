"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row produced,
nothing collected to the driver).  Prints one JSON line:
{"metric": ..., "value": total seconds, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# ---- headline queries: one per family of the operator inventory ---------------
HEADLINE = [
    "load_check",              # A1 + A2: scan and validate
    "describe",                # G1: exact describe
    "stratified_split",        # C3
    "undersample",             # C5
    "smote",                   # C6
    "knn_join",                # C7 exact
    "ranking_metrics",         # E4 / E5 over 12 runs
    "comparison_table",        # E8 / E9
    "batch_list",              # I10
    "batch_detail",            # I11
    "top_features",            # J1 + J2
    "counter_rate",            # L1
    "sustained",               # L6
    "running_balance",         # K3
    "class_histograms",        # G10
    "flagship",                # scale, split, weight, fit LR, score, summarise
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from ledgerlens.plans.entry import flagship, registered_queries
    from ledgerlens.session import build_session
    spark = build_session(cpus, int(cpus) if cpus != "*" else None, app_name="ledgerlens-bench")
    qs = registered_queries()
    qs["flagship"] = flagship
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
