"""Headline queries, timed one after another; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from checks import QUERIES  # noqa: E402

HEADLINES = [
    "j09_topk_similarity", "j09_topk_similarity_tiles", "j10_nearest_centroid", "g02_centroid", "g03_cluster_spread",
    "g05_intra_stats", "g07_inter_stats", "g07_vector_pair_stats", "g09_quality_flags", "g16_run_summary",
    "j01_embedding_image_card", "j07_inventory_resolve", "j13_name_match", "u01_upsert", "w01_number_vectors",
    "w05_class_index", "m02_triplets", "i03_image_statistics", "i06_encode", "i07_export_analysis",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["i06_encode"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = Path(sf_dir).name.removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
