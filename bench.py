"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from haulage import workload
from haulage.session import build_session

HEADLINE = [
    "agg_count",
    "agg_count_by",
    "agg_count_avg",
    "agg_count_sum",
    "load_then_average",
    "table_roundtrip",
    "load_append",
    "load_clustered",
    "load_report",
    "snapshot_as_of",
    "table_stats",
    "column_stats",
    "conform_types",
    "unmapped_to_string",
    "truncate_ns",
    "nan_to_null",
    "surrogate_key",
    "terms_lookup",
    "instalment",
    "json_contains",
    "check_unique",
    "check_unique_text",
    "check_fk",
    "check_not_null",
    "check_length",
    "dq_split",
    "dq_summary",
    "fk_cascade",
    "fk_set_null",
    "parent_child",
    "name_match",
    "ledger_balance",
    "ledger_mismatch",
    "ledger_from_opening",
    "first_per_group",
    "running_count",
    "sample_keys",
    "union_all",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        workload.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    times = {}
    for name in HEADLINE:
        run(name)
        times[name] = round(statistics.median(run(name) for _ in range(3)), 4)
    print(
        json.dumps(
            {
                "metric": "headline queries, median of three after a warm-up",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
