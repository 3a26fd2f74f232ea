"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")

from pyspark.sql import SparkSession

from tidefut.jobs import registry


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    # the session's first query would pay for its start
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_shipdate").count().write.format("noop").mode("overwrite").save()
    took = {}
    for name in ("backward_adjusted", "forward_adjusted", "roll_schedule", "clean_bulletins", "merged_days", "deduplicated_rows", "missing_sessions", "ohlcv_carried_forward", "localized_numbers"):
        began = time.time()
        registry.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
