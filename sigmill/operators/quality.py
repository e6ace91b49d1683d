"""Quality checks, chronological splits and other row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigmill.functions import frames as fr

PRICES = ("open", "high", "low", "close", "volume", "quote_volume")


def quality_checks(bars: DataFrame, interval: int, keys=fr.KEYS) -> DataFrame:
    """One row a key and check: check_name, count, ratio, status.

    Negative values and broken high/low ordering fail; duplicates, gaps, many
    zero volumes and large jumps warn.
    """
    at = fr.line(keys)
    c, before = F.col("close"), F.lag("close").over(at)
    gap = F.col(fr.TIME) - F.lag(fr.TIME).over(at)
    flagged = bars.withColumns(
        {
            "duplicates": (F.count(F.lit(1)).over(Window.partitionBy(*keys, fr.TIME)) > 1) & (F.row_number().over(Window.partitionBy(*keys, fr.TIME).orderBy(fr.TIME)) > 1),
            "negative_values": fr.any_of([F.coalesce(F.col(x) < 0, F.lit(False)) for x in PRICES]),
            "high_too_low": F.coalesce(F.col("high") < F.greatest("open", "close"), F.lit(False)),
            "low_too_high": F.coalesce(F.col("low") > F.least("open", "close"), F.lit(False)),
            "zero_volume": F.coalesce(F.col("volume") == 0, F.lit(False)),
            "close_jump": F.coalesce(F.abs(fr.divide(c, before) - 1) > 0.10, F.lit(False)),
            "gaps": F.coalesce(gap > interval, F.lit(False)),
        }
    )
    names = ["duplicates", "negative_values", "ohlc_invariant", "zero_volume", "close_jump", "gaps"]
    counts = {n: F.count_if(F.col(n)) for n in names if n != "ohlc_invariant"}
    counts["ohlc_invariant"] = F.count_if("high_too_low") + F.count_if("low_too_high")
    per = flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[counts[n].alias(n) for n in names])
    long = per.unpivot([*keys, "rows"], names, "check_name", "count")
    ratio = F.col("count") / F.col("rows")
    bad = F.when(F.col("check_name").isin("negative_values", "ohlc_invariant"), F.lit("fail")).otherwise(F.lit("warn"))
    over = F.when(F.col("check_name") == "zero_volume", ratio > 0.01).otherwise(F.col("count") > 0)
    return long.select(*keys, "check_name", "count", ratio.alias("ratio"), F.when(over, bad).otherwise(F.lit("pass")).alias("status"))


def with_position(df: DataFrame, keys=fr.KEYS) -> DataFrame:
    """rn (from 0) and n (rows of the key)."""
    return df.withColumns({"rn": F.row_number().over(fr.line(keys)) - 1, "n": F.count(F.lit(1)).over(fr.whole(keys))})


def split_plan(bars: DataFrame, *, discovery: float = 0.6, validation: float = 0.2, holdout: float = 0.2, gap: int = 0, keys=fr.KEYS) -> DataFrame:
    """Add split: discovery, validation and holdout in order of time, and gap.

    The holdout is the last part. ``gap`` rows are taken off the end of the
    two earlier parts so that no window reaches across, from both or, where
    one of them would keep fewer than ``gap`` rows, from neither. A key with
    one row is all discovery. Parts are rounded half to even.
    """
    p = with_position(bars, keys)
    n, rn, one = F.col("n"), F.col("rn"), F.lit(1)
    last = F.least(F.greatest(one, F.bround(n * holdout).cast("long")), n - 1)
    middle = F.when(n - last >= 2, F.least(F.greatest(one, F.bround(n * validation).cast("long")), n - last - 1)).otherwise(F.lit(0))
    final = n - last
    target = F.bround(n * discovery).cast("long")
    begin = F.when((middle > 0) & (target > 0), F.least(final - middle, F.greatest(one, target))).otherwise(final - middle)
    begin = F.greatest(one, F.least(begin, final))
    p = p.withColumns({"_begin": begin, "_final": final, "_middle": middle})
    begin, final, middle = F.col("_begin"), F.col("_final"), F.col("_middle")
    room = (begin - gap >= gap) & ((middle == 0) | (final - begin - gap >= gap))
    g = F.when(room, F.lit(gap)).otherwise(F.lit(0))
    kind = F.when(n <= 1, "discovery").when(rn < begin - g, "discovery").when(rn < begin, "gap")
    kind = kind.when((rn < final - g) | ((middle == 0) & (rn < final)), "validation").when(rn < final, "gap").otherwise("holdout")
    return p.withColumn("split", kind).drop("rn", "n", "_begin", "_final", "_middle")


def walk_forward_mask(bars: DataFrame, *, train: int, validation: int, test: int, purge: int, embargo: int, keys=fr.KEYS) -> DataFrame:
    """Add oos: rows in the repeating test windows; if there are none, the last quarter."""
    p = with_position(bars, keys)
    first = train + validation + purge
    inside = (F.col("rn") >= first) & (F.pmod(F.col("rn") - first, F.lit(test + embargo + purge)) < test)
    some = F.max(inside.cast("int")).over(fr.whole(keys)) == 1
    last = F.col("rn") >= F.floor(F.col("n") * 0.75)
    return p.withColumn("oos", F.when(some, inside).otherwise(last)).drop("rn", "n")


def median_interval(bars: DataFrame, keys=fr.KEYS) -> DataFrame:
    d = bars.withColumn("_d", F.col(fr.TIME) - F.lag(fr.TIME).over(fr.line(keys)))
    return d.where("_d > 0").groupBy(*keys).agg(F.percentile("_d", F.lit(0.5)).alias("median_ms"))


def block_sample(bars: DataFrame, *, block_ms: int, share: float, seed: int, keys=fr.KEYS) -> DataFrame:
    """Whole blocks of time, chosen by a seeded hash; rows stay in order of time."""
    block = F.floor(F.col(fr.TIME) / block_ms)
    u = F.pmod(F.xxhash64(F.lit(seed), *keys, block), F.lit(1 << 30)) / float(1 << 30)
    return bars.where(u < share)


def keep_labels(df: DataFrame, label: str, allowed: list[str], column: str = "signal") -> DataFrame:
    """The signal where the label is allowed, else 0."""
    return df.withColumn(column, F.when(F.col(label).isin(allowed), F.col(column)).otherwise(F.lit(0.0)))


def first_per_family(df: DataFrame, family: str, order: list, quota: int) -> DataFrame:
    w = Window.partitionBy(family).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= quota).drop("_n")
