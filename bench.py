"""Runs headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line with seconds a query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "flagship keycount keyadd keyaverage keyvariance heavyhitters top groupevents firstn uniq keyflow keyrate keyewma uniqexpire stateclimb_clamped persist lastn lastn_query appendlast jointuple jointuple_once "
    "redis_get sort match_tag re2 calc_arithmetic calc_keyed calc_window calc_running graph_streams decodejson tuple2json hmac_sha256 strings"
).split()


def main() -> None:
    from pyspark.sql import SparkSession

    from eventloom.plans import catalog

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.flagship(spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    rate = {k: round(events / took[k]) for k in ("firstn", "keyflow", "lastn", "keyewma", "uniqexpire")}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "events_per_sec": rate, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
