"""Wall-clock time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores, ``BENCH_KEYS``
(comma separated) other keys, ``BENCH_RUNS`` the timed runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = (
    "r_cohort", "r_cohort_retention", "r_shipping_type_sla", "r_shipments_base", "r_shipments_2025", "r_sales_margin",
    "r_repurchase", "r_sale_item_status_times", "r_customer_success", "r_stock", "r_art_control", "r_shipping_queue",
    "d_status_pairs", "d_error_episodes", "d_alloc_factor", "d_latest_per_key", "d_business_days_between",
    "q_agg_basic", "q_join_multikey", "q_win_lag",
)


def main() -> None:
    from bizlake.catalog import load
    from bizlake.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = [k for k in os.environ.get("BENCH_KEYS", "").split(",") if k]
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    keys = list(queries) if wanted == ["all"] else wanted or list(HEADLINE)
    seconds: dict[str, float] = {}
    for key in keys:
        took = []
        for turn in range(runs + 1):
            started = time.perf_counter()
            queries[key](spark, folder).write.format("noop").mode("overwrite").save()
            if turn or not runs:
                took.append(time.perf_counter() - started)
        seconds[key] = round(statistics.median(took), 3)
        print(key, seconds[key], file=sys.stderr)
    name = os.path.basename(os.path.normpath(folder))
    print(
        json.dumps(
            {"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": name.removeprefix("sf")}
        )
    )


if __name__ == "__main__":
    main()
