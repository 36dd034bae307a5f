"""Headline queries on local cores; prints one JSON line.

BENCH_SF_DIR: directory of the tables (default /root/testdata/sf0.1). BENCH_CPUS: cores (default 8).
BENCH_QUERIES: comma-separated names instead of the headline queries.
"""

from __future__ import annotations

import json
import os
import time

from runlens.plans import all_queries
from runlens.session import drop_scratch, local_session

HEADLINE = [
    "wx_anomalies", "agg2_error_rate", "agg4_orders", "win1_zscore", "win2_lineitem", "jn1_enrich", "agg5_function_stats",
    "agg6_repeats", "agg7_coalesce_io", "agg17_duplicates", "jn14_read_after_write", "jn17_call_target", "jn3_interval",
    "win5_islands", "win6_event_occurrence", "win8_next_event", "win11_loop_collapse", "win15_snapshot_changes", "gr1_import_closure",
    "gr4_chain", "gr8_budget", "fn1_redact", "fn11_sql_kind", "obs9_ledger", "obs11_fingerprint", "chk5_explanations",
    "str2_running_counts", "str7_first_calls",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = all_queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    # start the JVM's compiler and the Python workers outside the clock
    spark.read.parquet(f"{path}/events.parquet").groupBy("event_type").count().write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, path).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    drop_scratch(spark)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": path.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
