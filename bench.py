"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from postmill.plans import registry as catalog

#: lexeme_counts comes before the searches: it writes the stored index that they read, and its time is the index's.
HEADLINE = (
    "volume_cube_hour volume_cube_day_local author_activity price_stats_iqr price_distribution deal_score trend_hist trend_1h_z trend_24h_lift spike_daily "
    "inbox_join hidden_antijoin repost_fold neighbour_visits upsert_fold notify_merge watchdog_gap fingerprint_dedup lexeme_counts search_terms search_phrase_exclude search_relevance_page match_watches keyset_page_newest"
).split()


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    catalog.QUERIES["capped_total"](spark, folder).collect()  # starts the engine
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
