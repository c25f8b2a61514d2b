"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line of seconds."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from claimgraph.queries import queries

HEADLINE = ["reconcile_by_type", "candidate_join_token", "candidate_join", "layout_sections", "batch_sections", "locate_quote_exact", "validate_relationships"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.time()
            queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
