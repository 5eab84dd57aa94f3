"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from auditflow.plans.queries import QUERIES
from auditflow.session import local_session

HEADLINE = (
    "metric_summary",
    "monthly_trend",
    "period_comparison",
    "breakdown_channel",
    "breakdown_segment",
    "breakdown_multi",
    "customer_dynamics_day",
    "customer_dynamics_month",
    "forecast_eligibility",
    "pareto_customers",
    "month_channel_pivot",
    "exclusion_ledger",
    "quarantine_rows",
    "safe_join_check",
    "safe_join_rows",
    "safe_join_salted",
    "join_chain",
    "relationship_inference",
    "column_profile",
    "quality_issues",
    "reconciliation_check",
    "status_rollup",
    "question_router",
    "filter_answers",
    "transition_violations",
    "run_status",
    "redact_text",
    "table_digest",
    "provenance_ledger",
    "chart_datasets",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "auditflow-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM's threads
    timings = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
