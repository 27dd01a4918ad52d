"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from ledgerbeam.plans.registry import QUERIES

HEADLINE = [
    "enrich_ledger", "rule_classify", "rule_table_classify", "sumifs_eq", "sumifs_multi", "countif_presence",
    "maxifs_then_sum_after", "first_match_lookup", "asof_last_row", "tie_out", "version_diff", "hierarchy_proof",
    "weighted_rate", "subtotal_rollup", "effective_rate", "compound_interest_best_basis", "classification_waterfall",
    "schedule_closed_form", "schedule_recurrence", "irr_bisection", "forward_fill", "gloss_amounts",
    "balance_by_obligation", "interest_by_obligation", "dashboard",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):  # the first run warms up
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(min(times[1:]), 4)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline queries, best of two warm runs, summed", "value": total, "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
