"""Headline queries, timed in a warm session; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local threads, BENCH_RUNS the timed runs
per query (the median is reported).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from seqnet.catalog.queries import QUERIES  # noqa: E402

HEADLINES = [
    "pair_frequencies",
    "state_network",
    "brand_pair_frequencies",
    "read_transactions",
    "token_network",
    "relative_weight",
    "temporal_influence",
    "temporal_influence_day",
    "influence_edges",
    "max_rooted_branching",
    "forward_tree",
    "back_forward_polytree",
    "topk_polytree",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("seqnet-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in HEADLINES:
        seconds = []
        for run in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if run:
                seconds.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(seconds), 3)
    spark.stop()
    scale = Path(folder).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": scale}))


if __name__ == "__main__":
    main()
