import numpy as np
import pandas as pd

from sigmill.operators import evidence, rules, simulate
from sigmill.plans import methods
from sigmill.sources import rest

from .test_operators import walk


def test_report_feeds_the_tiers(spark):
    p = walk(500)
    future = p.open.shift(-2) / p.open.shift(-1) - 1
    sig = pd.DataFrame({"candidate_id": "seer", "symbol": "A", "open_time": p.open_time, "signal": np.tanh(future.fillna(0) * 200)})
    path = simulate.backtest(spark.createDataFrame(sig), spark.createDataFrame(p), sizing=simulate.Sizing(window_days=1))
    path = path.withColumn("regime", (path.open_time % 2).cast("string"))
    r = evidence.report(path, label="regime", horizons=(1, 3))
    x = r.first()
    assert x.max_abs_ic > 0.9 and x.best_horizon == 1 and x.ic_ci_excludes_zero and x.gross_sharpe > x.net_sharpe and set(x.ic_by_horizon) == {1, 3}
    tiers = rules.stratify(r.withColumnRenamed("candidate_id", "experiment_id"))
    assert tiers.first().evidence_level in ("strong", "moderate")


def test_methods(spark):
    assert methods.registry(spark).count() == 84 and methods.schedulable(spark).count() == 19
    assert methods.registry(spark).where("is_ml").count() == 13


def test_paged_source(spark):
    def fetch(symbol, start, end, limit):
        step = 86_400_000
        first = -(-start // step) * step
        return [(t, float(t // step)) for t in range(first, end, step)][:limit]

    rest.register(spark, "daily_api", fetch, "open_time long, value double", limit=7)
    end = 100 * 86_400_000
    df = spark.read.format("daily_api").option("symbols", "a, b").option("start_ms", 0).option("end_ms", end).load()
    assert df.count() == 200 and df.select("symbol", "open_time").distinct().count() == 200 and df.rdd.getNumPartitions() == 8
