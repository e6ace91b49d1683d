"""As-of joins as one union and one window, and the other joins by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmill.functions import frames as fr
from sigmill.sources.bars import first_per_time


def as_of(bars: DataFrame, events: DataFrame, value: str, *, event_time: str = "calc_time", default: float | None = None, name: str | None = None, keys=fr.KEYS) -> DataFrame:
    """Add the value of the last event at or before each bar (``default`` before the first).

    Of events at the same time the last counts; a missing value does not hide
    an older one. One shuffle by key serves both sides.
    """
    name = name or value
    e = first_per_time(events.select(*keys, event_time, value), keys, event_time, last=True)
    e = e.select(*keys, F.col(event_time).alias(fr.TIME), fr.finite(F.col(value).cast("double")).alias("_value"), F.lit(0).alias("_bar"))
    both = bars.withColumns({"_bar": F.lit(1), "_value": F.lit(None).cast("double")}).unionByName(e, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(fr.TIME, "_bar").rowsBetween(Window.unboundedPreceding, 0)
    got = F.last("_value", ignorenulls=True).over(w)
    got = F.coalesce(got, F.lit(default)) if default is not None else got
    return both.withColumn(name, got).where("_bar = 1").drop("_bar", "_value")


def event_zscore(events: DataFrame, value: str, *, n: int = 21, time: str = "calc_time", name: str = "zscore", keys=fr.KEYS) -> DataFrame:
    """z-score over the last n events (not bars)."""
    return events.withColumn(name, fr.zscore(F.col(value), n, fr.trailing(n, keys, time)))


def as_of_forward_sum(bars: DataFrame, events: DataFrame, value: str, *, event_time: str = "calc_time", name: str = "flow", keys=fr.KEYS) -> DataFrame:
    """Add the sum of events that land on each bar: the first bar at or after them.

    Events before the first or after the last bar of their key are dropped;
    bars without events get 0.
    """
    e = events.select(*keys, F.col(event_time).alias(fr.TIME), F.col(value).cast("double").alias("_value"), F.lit(0).alias("_bar"))
    both = bars.withColumns({"_bar": F.lit(1), "_value": F.lit(None).cast("double")}).unionByName(e, allowMissingColumns=True)
    # events sort before the bar of their time, so a bar closes the group of events since the bar before
    w = Window.partitionBy(*keys).orderBy(fr.TIME, "_bar").rowsBetween(Window.unboundedPreceding, 0)
    closed = both.withColumn("_before", F.sum("_bar").over(w) - F.col("_bar"))
    flow = F.sum("_value").over(Window.partitionBy(*keys, "_before"))
    early = F.col("_before") == 0  # before the first bar only its own time counts
    own = F.sum(F.when(F.col("_bar") == 0, F.col("_value"))).over(Window.partitionBy(*keys, fr.TIME))
    return closed.withColumn(name, F.coalesce(F.when(early, own).otherwise(flow), F.lit(0.0))).where("_bar = 1").drop("_bar", "_value", "_before")


def exact(bars: DataFrame, events: DataFrame, value: str, *, event_time: str = "calc_time", default: float = 0.0, keys=fr.KEYS) -> DataFrame:
    e = events.groupBy(*keys, F.col(event_time).alias(fr.TIME)).agg(F.sum(value).alias(value))
    return bars.join(e, [*keys, fr.TIME], "left").withColumn(value, F.coalesce(value, F.lit(default)))


def align(frames: dict[str, DataFrame], keys=fr.KEYS) -> DataFrame:
    """Outer alignment on (key, time): one column a name, without joins."""
    parts = [df.select(*keys, fr.TIME, F.lit(n).alias("_name"), F.col("value").cast("double").alias("_v")) for n, df in frames.items()]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return long.groupBy(*keys, fr.TIME).agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in frames])


def densify(df: DataFrame, across: str, along: str, values: list[str], fill: float = 0.0) -> DataFrame:
    """Every (time, name) pair that is missing gets ``fill``.

    The grid is times joined to the names of a dimension table; names are few.
    """
    times, names = df.select(along).distinct(), df.select(across).distinct().agg(F.collect_set(across).alias("_all"))
    grid = times.withColumn("_k", F.lit(1)).join(names.withColumn("_k", F.lit(1)), "_k").select(along, F.explode("_all").alias(across))
    return grid.join(df, [along, across], "left").fillna(fill, values)


def strict_zip(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key``; raises unless both sides hold exactly the same keys."""
    seen = left.select(key, F.lit(1).alias("l")).join(right.select(key, F.lit(1).alias("r")), key, "full_outer")
    if (n := seen.where("l is null or r is null").count()):
        raise ValueError(f"{n} keys are on one side only")
    return left.join(right, key)


def novel(new: DataFrame, *known: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Rows whose key is in none of ``known``, once for each key."""
    seen = known[0].select(key)
    for k in known[1:]:
        seen = seen.unionByName(k.select(key))
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in new.columns if c != key] or [key])))
    return first.where("_n = 1").drop("_n").join(seen.distinct(), key, "left_anti")


def against_parent(signals: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidate_id, parent_id, corr: how far a repair's signal repeats its parent's."""
    own = signals.join(candidates.where("parent_id is not null").select("candidate_id", "parent_id"), "candidate_id")
    parent = signals.select(F.col("candidate_id").alias("parent_id"), "symbol", fr.TIME, F.col("signal").alias("_parent"))
    both = own.join(parent, ["parent_id", "symbol", fr.TIME])
    r: Column = fr.corr_agg(F.col("signal"), F.col("_parent"))
    return both.groupBy("candidate_id", "parent_id").agg(F.abs(r).alias("corr"))
