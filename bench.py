"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from millrace.plans import catalogue
from millrace.session import session

QUERIES = (
    "top_parts_by_nation_year equi_join left_join_count pricing_summary aggregates_basic aggregates_statistics percentiles_by_rank grouping_sets window_frames window_ranking "
    "conditional_true_event count_distinct_over qualify asof_join interval_join pivot_list match_recognize strings_regexp numbers_basic variants vectors dml_merge"
).split()
#: The first run warms up, the median of the others counts.
RUNS = 4


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    took: dict[str, float] = {}
    for name in QUERIES:
        times = []
        for _ in range(RUNS):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times[1:]), 3)
    print(json.dumps({"metric": "sum of warm query times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir}))


if __name__ == "__main__":
    main()
