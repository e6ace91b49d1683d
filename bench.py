"""Seconds of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Each query is run to the end without keeping its rows, the
first after a warm-up.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from sigmill import queries as engine

HEADLINE = [
    "dsl_ts_zscore", "dsl_nested", "dsl_ts_rank", "dsl_rank", "indicator_sma", "indicator_cci", "indicator_ema", "asof_backward", "asof_forward_sum", "quality_checks",
    "strategy_returns", "metrics", "backtest_full", "xs_long_short", "xs_ic", "rolling_ic", "newey_west", "benjamini_hochberg", "gatecheck", "research_gate", "merge_pool", "trial_counts",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    engine.QUERIES["dsl_ts_zscore"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.time()
        engine.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
