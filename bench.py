"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
cores.  Every query runs whole and its rows go to Spark's no-op sink, so neither
the driver nor a client is part of the time.  BENCH_ALL=1 times all queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from check import session
from loadlens.plans.catalogue import QUERIES
from loadlens.plans.search import index_folder

HEADLINES = (
    "latency_summary",
    "kv_op_summary",
    "percentile_table",
    "concurrency_peak",
    "message_quality",
    "fanout_latency",
    "kv_reads_as_of",
    "kv_final_state",
    "key_popularity",
    "topk_per_group",
    "inverted_index",
    "index_build",
    "term_stats",
    "search_topk",
    "search_topk_sharded",
    "search_topk_blocks",
    "query_replay",
    "pagerank",
    "monte_carlo_pi",
    "perf_report_rows",
    "node_logs",
    "stream_counts",
    "stream_kv_state",
    "requests_in_pauses",
    "moving_latency",
    "user_sessions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINES
    spark = session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the executor threads and the file system classes.
    spark.read.parquet(f"{sf_dir}/region.parquet").write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        if name == "index_build":  # what the searches after it read
            index_folder(spark, sf_dir)
        else:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name:24} {took[name]:8.3f}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
