"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from vellum import plans

HEADLINE = [
    "f2_related_sentences", "h1_candidate_cuts", "e1_paragraphs", "e3_column_clusters", "c4_interval_overlap", "c12_figure_tops", "c17_near_boxes", "d10_aligned_columns",
    "d1_upper_median_by_source", "e4_reference_section", "e6_recent_history", "g7_components", "h13_strip_markup", "i5_event_fold", "i7_think_filter", "k4_split_sentences",
]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, queries = {}, plans.queries()
    for table in ("documents", "events", "conversations", "pages"):  # start workers, compile, fill the page cache
        spark.read.parquet(f"{d}/{table}.parquet").groupBy().count().collect()
    for name in HEADLINE:
        t = time.time()
        queries[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
