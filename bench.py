"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads, BENCH_ONLY a comma-separated choice.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from onsetlens.plans.catalog import QUERIES  # noqa: E402
from onsetlens.session import local_session  # noqa: E402

HEADLINE = (
    "load_tests",
    "check_values",
    "cohort_counts",
    "dense_ids",
    "infection_bounds",
    "positivity_by_day",
    "person_patterns",
    "test_loglik",
    "marginal_loglik",
    "infection_day_counts",
    "curve_summary",
    "empirical_curve",
    "panel_f",
    "prior_sensitivity",
    "fit_parameters",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the session outside the timings
    times = {}
    for name in chosen:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
