"""Time the headline queries and print one JSON line.

Settings: BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8). Each query runs once to warm up the
session's code paths on the small data and is then timed on the bench data, results written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tractloom.catalog import load  # noqa: E402
from tractloom.session import build_session  # noqa: E402

HEADLINE = [
    "tract_year_concentration", "a07_lender_mix", "a08_county_lending", "a09_branch_market", "a11_application_rollup",
    "a13_entity_churn", "a15_residualize", "a17_desert_flags", "a18_forward_labels", "j03_asof_vintage", "j04_apportion",
    "a14_reaggregate", "j09_count_within", "j10_nearest", "j11_recent_closures", "j15_entity_matching", "j22_knn_peers",
    "w03_lagged_sums", "w04_percentile_rank", "m05_fold_metrics", "m09_decision_curve", "m17_overlay_sweep",
    "a19_county_rollup", "a23_percentile_catalog", "a26_county_drivers", "v02_scenario_risk",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(max(8, int(cpus))), "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    only = sys.argv[1:] or HEADLINE
    load_warm = registry["tract_year_concentration"].build(spark, directory)
    load_warm.write.format("noop").mode("overwrite").save()
    times = {}
    for name in only:
        start = time.perf_counter()
        registry[name].build(spark, directory).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(directory)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(scale[2:]) if scale.startswith("sf") else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
