"""Timings of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from spendshift.session import prepare  # noqa: E402
from spendshift.workloads import case  # noqa: E402
from spendshift.workloads.catalog import QUERIES  # noqa: E402
from spendshift.workloads.views import cost_rows  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "a1_daily_rollup",
    "a2_daily_totals",
    "a3_period_comparison",
    "a4_group_changes",
    "a17_provider_reconciliation",
    "c9_cost_breakdown",
    "s1_aws_export_csv",
    "j3_candidate_audit_events",
    "j6_rule_selection",
    "p1_focus_projection",
    "p18_injection_shapes",
    "p26_page_fingerprints",
    "k4_newest_states",
    "w1_group_positions",
    "c7_investigation",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("spendshift-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    # The first scan pays for class loading and code generation; no headline query should.
    cost_rows(prepare(spark), SF_DIR).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        # Nothing computed for one query may help the next.
        case.forget_settled()
        started = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "cost_rows": lines,
        "cost_rows_per_second": {
            name: round(lines / seconds[name]) for name in ("a1_daily_rollup", "a3_period_comparison", "a4_group_changes")
        },
    }))


if __name__ == "__main__":
    main()
