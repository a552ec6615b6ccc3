"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder (default /root/testdata/sf0.1) and
BENCH_CPUS the local cores (default 8). Each query is built and run to the end
once to warm up and three times for its median; the tables that it wrote on the
way are deleted.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stationwise.plans.queries import all_queries  # noqa: E402
from stationwise.session import clear_work, local_session  # noqa: E402

RUNS = 3

HEADLINE = [
    "heat_runs",
    "obs_wide",
    "station_eligibility",
    "threshold_calendar_window",
    "thresholds_all",
    "baseline_calendar_mean",
    "daily_flags",
    "events_all",
    "longest_dry_run",
    "station_year_metrics",
    "station_summary",
    "trend_theil_sen",
    "mann_kendall",
    "percentile_rank",
    "knn_edges",
    "gi_star",
    "morans_i",
    "summary_with_risk",
    "season_reconcile",
    "storm_validation",
    "date_expand_capped",
    "haversine_lanes",
    "fixed_width_daily",
    "spread_selection",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    known = all_queries()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + RUNS):
            started = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
            clear_work(spark)
        seconds[name] = round(median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
