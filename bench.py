"""Times the registered queries and prints one JSON line.

BENCH_SF_DIR names the folder of tables and BENCH_CPUS the number of local threads. Each
query runs once to warm up and then BENCH_RUNS times; the median counts. Results go to the
noop sink, so every row and column is computed and nothing is collected. BENCH_QUERIES
chooses queries by name, or ``all``; without it, close variants of a query are left out.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from walletlens.checks.queries import all_queries
from walletlens.plans.session import local_session, prepare_stream

# Close variants of a query that is timed.
VARIANTS = {
    "value_share_region",
    "geo_summary_prefix",
    "type_count",
    "type_share",
    "anomaly_type_count",
    "salary_compare",
    "report_channel_share",
    "report_geo_summary",
    "report_salary_compare",
    "report_daily_summary",
    "top_ten_regions",
    "missing_column_defaults",
    "text_row_validation",
    "text_row_violations",
    "text_unreadable_timestamps",
    "text_quarantine",
    "text_stream_validate",
    "appended_batches",
    "first_rows",
    "rows_in_days",
    "evening_share",
    "bill_day_profile",
    "channel_mix_by_region_class",
    "corridor_matrix",
    "rule_label",
    "stream_hourly",
    "stream_tontine_estimate",
    "stream_exact_split",
    "stream_exact_suppressed",
    "circle_turns",
    "text_csv_round_trip",
    "text_json_round_trip",
}


def seconds(query, spark, folder: str) -> float:
    started = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name]
    spark = prepare_stream(local_session(cpus, "walletlens-bench"))
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    timings = {}
    for name, query in all_queries().items():
        if name in VARIANTS if not chosen else "all" not in chosen and name not in chosen:
            continue
        seconds(query, spark, folder)
        timings[name] = round(statistics.median(seconds(query, spark, folder) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries, median run each; close variants are left out",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": cpus,
                "input_rows": rows,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
