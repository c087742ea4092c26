"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores, BENCH_RUNS
(default 3) how often each query runs. All queries run once, then all again; a query's time is the median
of its runs. No round begins after BENCH_SECONDS (default 240). ``first`` has the time of each first run,
``rows`` the number of rows, ``runs`` the number of rounds.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from heatstrata.session import local_session  # noqa: E402
from workload import registry  # noqa: E402

HEADLINES = (
    "clean_deaths", "daily_sum", "daily_subgroup", "deaths_period", "join_deaths_weather",
    "thresholds_window", "heat_indicators", "heat_user_panel", "threshold_events", "heat_days_period", "heat_descriptives",
    "cc_strata", "cc_overall", "cc_battery", "cc_by_state", "cc_by_subgroup", "cc_user_panel", "cc_region_days",
    "an_state_period", "report_descriptive", "cc_stored_battery", "cc_refreshed", "report_sections",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["cc_region_days"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up
    wanted, limit = max(1, int(os.environ.get("BENCH_RUNS", "3"))), float(os.environ.get("BENCH_SECONDS", "240"))
    taken: dict[str, list[float]] = {name: [] for name in HEADLINES}
    rows, runs, began = {}, 0, time.perf_counter()
    while runs < wanted and (not runs or time.perf_counter() - began < limit):
        for name in HEADLINES:
            start, seen = time.perf_counter(), Observation()
            df = registry.QUERIES[name](spark, sf_dir).observe(seen, F.count(F.lit(1)).alias("n"))
            df.write.format("noop").mode("overwrite").save()
            taken[name].append(round(time.perf_counter() - start, 3))
            rows[name] = seen.get["n"]
        runs += 1
    seconds, first = {n: round(median(t), 3) for n, t in taken.items()}, {n: t[0] for n, t in taken.items()}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first": first,
                "rows": rows,
                "runs": runs,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
