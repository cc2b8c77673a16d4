"""Headline queries, each run to its last row; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from scrollsift.plans import registry

#: keyword_load comes before the other searches, so its time has the building of the index that they read.
HEADLINE = ["filter_pipeline", "filter_stats", "tier1_dedup", "tier2_scores", "entity_all", "pages_entities", "host_paths", "blob_dedup_refcount", "knn_cosine", "knn_batch", "keyword_load", "bm25_topk", "hybrid_search", "keyword_postings", "host_nodes", "session_rollup"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.QUERIES
    queries["session_rollup"](spark, folder).count()  # starts the JVM's threads and opens the tables
    took = {}
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
