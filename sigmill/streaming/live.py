"""Structured Streaming: ticks to bars, late data, stateful positions, resumable runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.functions import frames as fr


def stream_bars(ticks: DataFrame, *, key: str, time: str, price: str, tie: str, every: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) bars of a stream of ticks; bars close when the watermark passes."""
    order = F.struct(time, tie)
    w = F.window(time, every, slide) if slide else F.window(time, every)
    g = ticks.withWatermark(time, late).groupBy(F.col(key).alias("symbol"), w.alias("w"))
    bars = g.agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"), F.sum(price).alias("quote_volume"), F.count(F.lit(1)).alias("trade_count"),
    )
    return bars.select("symbol", F.unix_millis("w.start").alias(fr.TIME), "open", "high", "low", "close", "volume", "quote_volume", "trade_count")


def sessions(ticks: DataFrame, *, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows: start, end and number of events."""
    g = ticks.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def deduplicate(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first of equal keys within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def live_positions(stream: DataFrame, *, enter: float = 0.3, leave: float = 0.1, buffer: float = 0.05) -> DataFrame:
    """Hysteresis and buffer on a stream of (symbol, open_time, signal), state kept by symbol.

    Rows of a batch are taken in order of time; a batch and its replay give
    the same as the batch operators on the whole.
    """

    def step(key, frames, state):
        import pandas as pd

        held, now = state.get if state.exists else (False, 0.0)
        rows = pd.concat(list(frames)).sort_values(fr.TIME)
        out = []
        for t, s in rows[[fr.TIME, "signal"]].itertuples(index=False):
            held = abs(s) > min(leave, enter) if held else abs(s) >= enter
            target = s if held else 0.0
            if abs(target - now) > buffer:
                now = target
            out.append((key[0], t, float(now)))
        state.update((bool(held), float(now)))
        yield pd.DataFrame(out, columns=["symbol", fr.TIME, "position"])

    return stream.groupBy("symbol").applyInPandasWithState(step, f"symbol string, {fr.TIME} long, position double", "held boolean, now double", "append", "NoTimeout")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is, then stop; a later call goes on from the checkpoint."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def new_days(extents: DataFrame, last_ms: int) -> float:
    """Days of new data since ``last_ms`` that every instrument has."""
    least = extents.agg(F.min("last_ms")).first()[0]
    return max(0.0, ((least or last_ms) - last_ms) / 86_400_000)
