import numpy as np
import pandas as pd

from sigmill.operators.simulate import buffered, hysteresis
from sigmill.sources.bars import bars_from_ticks
from sigmill.streaming import live


def test_replay_of_a_stream_equals_the_batch(spark, tmp_path):
    ticks = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "cast(ts as timestamp) as ts", "event_type", "value")
    last = ticks.selectExpr("max(event_id) + 1 as event_id", "max(ts) + interval 1 day as ts", "'end' as event_type", "0.0D as value")
    ticks.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    bars = live.stream_bars(stream, key="event_type", time="ts", price="value", tie="event_id", late="40 days")
    live.run_available(bars, str(tmp_path / "out"), str(tmp_path / "ck"))
    last.write.mode("append").parquet(str(tmp_path / "in"))
    far = last.selectExpr("event_id + 1 as event_id", "ts + interval 90 days as ts", "event_type", "value")
    far.write.mode("append").parquet(str(tmp_path / "in"))
    live.run_available(bars, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).where("symbol <> 'end'")
    want = bars_from_ticks(ticks, key="event_type", time="ts", price="value", tie="event_id")
    cols = ["symbol", "open_time", "open", "high", "low", "close", "trade_count"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_stateful_positions_equal_the_batch(spark, tmp_path):
    s = np.sin(np.arange(90) / 5) * np.linspace(0, 1, 90)
    for i in range(3):
        part = pd.DataFrame({"symbol": "A", "open_time": np.arange(30 * i, 30 * i + 30), "signal": s[30 * i : 30 * i + 30]})
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = live.live_positions(spark.readStream.schema("symbol string, open_time long, signal double").parquet(str(tmp_path / "in")))
        live.run_available(out, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("open_time").toPandas().position
    np.testing.assert_allclose(got, buffered(hysteresis(s, 0.3, 0.1), 0.05))
