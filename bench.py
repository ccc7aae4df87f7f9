"""Headline-query benchmark.

Runs the headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and prints ONE JSON line. Each query is executed with the
``noop`` sink (full execution, no transfer to Python): one cold run, then
$BENCH_REPEAT warm runs whose median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from proofbox.plans import all_queries  # noqa: E402
from proofbox.session import get_session  # noqa: E402

HEADLINE = {
    "daily_table_D1": "daily_table",
    "features_I1": "features",
    "recommendation_I8_I9": "recommendation",
    "demand_fit_D7": "demand_fit",
    "backtest_E11_D8": "backtest_standins",
    "order_totals_C1": "order_totals",
    "points_balance_D12": "points_balance",
    "score_scenarios_I4": "score_scenarios",
    "menu_availability_B14": "menu_availability",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = get_session(cores=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")), app="proofbox-bench")
    qs = all_queries()
    warm, cold = {}, {}
    for label, name in HEADLINE.items():
        times = []
        for _ in range(1 + repeat):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        cold[label] = round(times[0], 3)
        warm[label] = round(statistics.median(times[1:]) if repeat else times[0], 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {
        "metric": "headline_total_warm",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
