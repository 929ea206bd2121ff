"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (threads), BENCH_RUNS (best of).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from starloom.queries import QUERIES  # noqa: E402
from starloom.session import local_session  # noqa: E402

HEADLINE = [
    "table_input",
    "filter_all",
    "calculator",
    "group_by_sum",
    "preaggregate",
    "merge_join_inner",
    "stream_lookup",
    "db_lookup_eq",
    "db_lookup_between_key",
    "lead_lag",
    "dedup_latest",
    "sort_rows",
    "add_sequence",
    "pivot",
    "unpivot",
    "split_rows",
    "mask_generic",
    "upsert_last_wins",
    "merge_rows_diff",
    "dim_scd1",
    "dim_scd2",
    "dim_multi_batch",
    "dim_lookup_asof",
    "fact_load",
    "sales_star",
    "inventory_star",
    "cleaning_rules",
    "rejected_rows",
    "check_fanout",
    "distinct_counts",
    "profile_table",
    "time_series",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus, "16g", spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # Start the executors and load the reader before anything is timed.
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in wanted:
        best = None
        for _ in range(runs):
            begin = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - begin
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
