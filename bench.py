"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once unmeasured and three times measured, with its rows dropped at the sink; its figure is the median.
"""

from __future__ import annotations

import json
import os
import re
import time
from statistics import median

from brindle.plans import catalog
from brindle.session import local

HEADLINES = [
    "tpch_q1", "agg_group_multi_key", "agg_high_cardinality", "agg_count_distinct", "agg_rollup", "agg_window", "filter_conjunction", "project_q1_exprs", "arith_int8", "cmp_col_col_float8",
    "date_le_timestamp", "fb_inner_join", "fb_semi_join", "fb_as_of_join", "fb_order_limit", "fb_time_bucket", "fb_multi_join_agg",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local(cores=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.queries(), {}
    for name in HEADLINES:
        took = []
        for _ in range(4):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(median(took[1:]), 4)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
