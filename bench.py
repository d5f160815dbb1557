"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = """feature_filter hierarchy_join preferred_name logistic_rank fold_text name_index_build split_prefixes leaf_depth search_exact search_prefix
search_topk search_two_trees search_country_filter search_area_filter search_batch get_by_id localise nearest_places nearest_batch json_render""".split()


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
    spark = builder.config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from waymark.plans import fixtures, queries

    times, began = {}, time.time()
    fixtures.database(spark, sf_dir)
    times["database_build"] = round(time.time() - began, 3)
    for name in HEADLINE:
        best = None
        for _ in range(2):
            began = time.time()
            queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.time() - began
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
