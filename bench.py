"""Headline queries on one local session; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "career_market_stats", "skill_demand_stats", "market_overview", "moving_90_day_demand", "normalized_postings", "redacted_documents",
    "dictionary_skill_tags", "career_title_mapping", "exact_duplicates", "fuzzy_duplicates_removed", "top_careers_per_profile",
    "what_if_added_skill", "skill_gap_and_readiness", "recommendation_rows", "micro_precision_recall", "manifest_counts",
    "traceability_audit", "session_profile_fold", "streamed_daily_demand",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from jobatlas.catalog import all_queries

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_orderstatus").count().collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        all_queries.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
