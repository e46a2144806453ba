"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_ONLY`` (names,
comma separated). Every query runs once to warm up and once for the clock; the result is written to the
``noop`` sink, so all columns of all rows are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from outagelab.queries import QUERIES
from outagelab.session import build_session

HEADLINE = (
    "latest_in_interval", "case_intervals", "interval_join", "latest_per_key", "case_next_day_left_join",
    "anti_join_cohort", "segment_cap", "top_n_per_group", "case_cohort", "control_cohort", "case_software", "case_hardware",
    "poweroff_summary", "clinic_flag", "network_gap_case", "case_variable_table", "control_variable_table",
    "ad_activity_case", "sessions_case", "touches_case", "two_level_daily_monthly", "month_pivot",
    "session_type_pivot", "brand_lookup", "multi_hot", "deciles", "exact_quantiles", "zscore", "balanced_sample",
    "split_60_20_20", "assemble_wide", "prevalence", "numeric_profile", "label_correlation", "report", "roc_points", "auc",
    "wide_table", "train_lr", "train_rf",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in only or HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
            spark.catalog.clearCache()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
