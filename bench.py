"""Times the store's headline queries. One JSON line: seconds of the second of two runs of each."""

import json
import os
import time

from pyspark.sql import SparkSession

from palimpsest import queries as Q

HEADLINE = ["q01_point_get", "q03_multi_get", "q03b_lookup_as_of", "q04_full_scan", "q06_range", "q09_prefix", "q15_version_history", "q19_wal_fold", "q21_flush_newest", "q22_merge_runs_newest", "q25_run_stats", "q31_snapshot_join"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            Q.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
