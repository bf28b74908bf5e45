"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is rebuilt for every repetition (a second action on one DataFrame would reuse finished
shuffles) and written to the noop sink; the figure is the best of two after a warm-up.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tessera.queries import QUERIES

HEADLINE = (
    "matrix_multiply_gram", "matrix_multiply_blocked", "matrix_multiply", "matrix_multiply_chain", "row_sum_of_product", "sum_of_product",
    "trace_of_product", "selection_of_product", "project_row_of_product", "add_element", "multiply_element", "divide_element", "row_sum",
    "col_sum", "vec", "rank_one_update",
)


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, d).df.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(min(took[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(d.rstrip("/"))}))


if __name__ == "__main__":
    sys.exit(main())
