"""Time the headline queries on one machine; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs to a sink that discards rows, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerloom import get_spark  # noqa: E402
from ledgerloom.catalog import registry  # noqa: E402

# reporting, quality, incremental and customer products; file round trips are timed by the last one
HEADLINE_PREFIXES = ("oq", "aq", "branch_report", "customer_360", "layer_fct", "layer_int", "layer_dim", "rq")
HEADLINE = [
    "dq_checks",
    "dq_validated_rows",
    "dq_metric_table",
    "dq_layer_tests",
    "dq_constraints",
    "m_first_accepted_wins",
    "m_all_copies_invalid",
    "m_upsert_outcomes",
    "m_upsert_table",
    "m_identical_files",
    "medallion_gold",
    "s_strict_rows",
    "s_branch_rows",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "ledgerloom-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry().queries
    names = [n for n in queries if n.startswith(HEADLINE_PREFIXES)] + HEADLINE
    # start-up and first reads of the tables are nobody's time
    for name in ("oq04_summary_by_type", "oq01_transactions_with_customer"):
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
