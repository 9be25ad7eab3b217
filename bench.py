"""Times the headline queries, the median of three runs each, and prints one JSON line.

``BENCH_SF_DIR`` names the input folder and ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from posequarry.plans import catalog
from posequarry.session import build_session

HEADLINE = (
    "M5_baseline_grid",
    "J7_radius_join",
    "C1_leader_clusters",
    "A13_progress",
    "A2_mean_n",
    "W1_sequence_ids",
    "J1_affinity_join",
    "S19_filtered_subset",
    "A26_contact_sets",
    "A18_box_summary",
    "P22_filter_waterfall",
    "P26_log_classes",
    "J13_kernel_density",
    "F1_feature_table",
    "K6_write_structures",
    "M2_reweighting_fit",
    "M6_results_matrix",
)
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        taken = []
        for _ in range(RUNS):
            started = time.perf_counter()
            catalog.PLANS[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(taken), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(folder.rstrip("/")).removeprefix("sf") or 0),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
