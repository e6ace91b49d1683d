"""Features and expressions to signals in -1..1, with controls, filters and composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmill.functions import frames as fr

# Multipliers by regime (bull, bear, sideways, high_vol) for a signal family.
MODULATION = {
    "momentum": (1.5, 0.3, 1.0, 0.5),
    "mean_reversion": (0.5, 1.5, 1.0, 0.7),
    "volatility": (0.7, 0.7, 0.5, 1.5),
    "funding_basis": (1.0, 1.2, 1.0, 0.5),
    "volume_confirmation": (1.3, 0.5, 0.8, 0.6),
}
REGIMES = ("bull", "bear", "sideways", "high_vol")
#: Number of each regime in expressions; 0 is unknown.
REGIME_NUMBER = {"bull": 1, "bear": 2, "sideways": 3, "high_vol": 4}


def factor_signal(bars: DataFrame, kind: str, lookback: int, *, name: str = "signal", keys=fr.KEYS) -> DataFrame:
    """The built-in signals: momentum, mean_reversion, volatility, funding_basis; any other kind is the deviation from VWAP.

    funding_basis fails, when it is evaluated, for an instrument whose funding is zero throughout.
    """
    c, n, at = F.col("close"), lookback, fr.line(keys)
    half = lambda z: F.coalesce(fr.tanh(z / 2), F.lit(0.0))
    if kind == "momentum":
        d = bars.withColumn("_m", fr.divide(c, F.lag(c, n).over(at)) - 1)
        s = fr.std(F.col("_m"), 4 * n, fr.trailing(4 * n, keys), n)
        return d.withColumn(name, half(fr.divide(F.col("_m"), F.when(s > 0, s)))).drop("_m")
    if kind == "mean_reversion":
        return bars.withColumn(name, half(-fr.zscore(c, n, fr.trailing(n, keys))))
    if kind == "volatility":
        w = fr.trailing(4 * n, keys)
        d = bars.withColumn("_r", fr.divide(c, F.lag(c).over(at)) - 1).withColumn("_v", fr.std(F.col("_r"), n, fr.trailing(n, keys)))
        q = lambda p: fr.full(F.percentile("_v", F.lit(p)), F.col("_v"), n, w, n)
        spread = q(0.75) - q(0.25)
        return d.withColumn(name, half(fr.divide(F.col("_v") - q(0.5), F.when(spread > 0, spread)))).drop("_r", "_v")
    if kind == "funding_basis":
        if "funding_zscore" not in bars.columns:
            raise ValueError("funding_basis needs funding_zscore")
        rate = F.coalesce(fr.finite(F.col("funding_zscore")), F.lit(0.0))
        some = F.sum(F.abs(rate)).over(fr.whole(keys)) > 1e-12
        return bars.withColumn(name, F.when(some, half(-fr.clip(rate, -6, 6))).otherwise(F.raise_error(F.lit("funding_basis needs funding that is not zero throughout")).cast("double")))
    w, long = fr.trailing(n, keys), fr.trailing(4 * n, keys)
    traded = F.when(fr.full(F.sum("volume"), F.col("volume"), n, w) != 0, F.sum("volume").over(w))
    v = fr.divide(fr.full(F.sum(c * F.col("volume")), c * F.col("volume"), n, w), traded)
    d = bars.withColumn("_d", F.coalesce(fr.finite(fr.divide(c, F.when(v != 0, v)) - 1), F.lit(0.0)))
    s = fr.std(F.col("_d"), 4 * n, long, n)
    return d.withColumn(name, half(-fr.divide(F.col("_d"), F.when(s > 0, s)))).drop("_d")


def smooth(df: DataFrame, column: str, span: int, keys=fr.KEYS) -> DataFrame:
    """Exponential average with weights that add up to 1 from the first row on; one grouped pass."""

    def run(pdf):
        pdf = pdf.sort_values(fr.TIME, kind="stable")
        return pdf.assign(**{column: pdf[column].ewm(span=span, min_periods=1).mean()})

    own = df.select(*dict.fromkeys([*keys, fr.TIME, column]))
    kinds = dict(own.dtypes)
    got = own.groupBy(*keys).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in own.columns))
    return df.drop(column).join(got, [*keys, fr.TIME])


def transform(df: DataFrame, feature: str, *, how: str = "tanh_zscore", direction: int = 1, window: int = 288, scale: float = 2.0, name: str = "signal", keys=fr.KEYS) -> DataFrame:
    """A feature as a signal: tanh of a smoothed z-score, rolling percentile rank, or clipped."""
    x, w = F.col(feature), fr.trailing(window, keys)
    if how == "tanh_zscore":
        d = df.withColumn(name, F.coalesce(fr.zscore(x, window, w, 20), F.lit(0.0)))
        return smooth(d, name, 12, keys).withColumn(name, direction * fr.tanh(F.col(name) / scale))
    if how == "rank":
        values = F.collect_list(x).over(w)
        d = df.withColumn("_v", values)
        below, same = F.size(F.filter("_v", lambda v: v < x)), F.size(F.filter("_v", lambda v: v == x))
        pct = (below + (same + 1) / 2) / F.size("_v")
        return d.withColumn(name, direction * F.coalesce(F.when((F.size("_v") >= 20) & x.isNotNull(), pct * 2 - 1), F.lit(0.0))).drop("_v")
    return df.withColumn(name, direction * F.coalesce(fr.clip(x, -1, 1), F.lit(0.0)))


def controls(df: DataFrame, column: str = "signal", *, span: int = 1, threshold: float = 0.0, keys=fr.KEYS) -> DataFrame:
    """Optional smoothing, a dead zone, and clipping to -1..1; missing is 0."""
    df = smooth(df, column, span, keys) if span > 1 else df
    x = F.coalesce(fr.finite(F.col(column)), F.lit(0.0))
    x = F.when(F.abs(x) >= threshold, x).otherwise(F.lit(0.0)) if threshold > 0 else x
    return df.withColumn(column, fr.clip(x, -1, 1))


def regime_filter(df: DataFrame, allowed: list[str], *, mode: str = "hard", weight: float = 0.25, column: str = "signal", label: str = "regime", keys=fr.KEYS) -> DataFrame:
    """Outside the allowed regimes: zero (hard), scale (soft), or no new positions (entry_only)."""
    inside = F.coalesce(F.col(label).isin(allowed), F.lit(False))
    x = F.col(column)
    if mode == "soft":
        return df.withColumn(column, F.when(inside, x).otherwise(x * min(1.0, max(0.0, weight))))
    if mode != "entry_only":
        return df.withColumn(column, F.when(inside, x).otherwise(F.lit(0.0)))
    # a run of one sign (or of zeros) passes from its first allowed row on; all before that is 0
    sign = F.signum(column)
    new = F.coalesce(sign != F.lag(sign).over(fr.line(keys)), F.lit(True)).cast("int")
    d = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(fr.running(keys))).withColumn("_in", inside)
    opened = F.max(F.col("_in").cast("int")).over(fr.line((*keys, "_run")).rowsBetween(Window.unboundedPreceding, 0)) == 1
    return d.withColumn(column, F.when(opened, x).otherwise(F.lit(0.0))).drop("_new", "_run", "_in")


def regime_signs(df: DataFrame, signs: dict[str, float], column: str = "signal", label: str = "regime") -> DataFrame:
    """The signal times the sign (1, 0, -1) given for its regime; 1 for others."""
    out: Column = F.col(column)
    for name, value in signs.items():
        out = F.when(F.col(label) == name, F.col(column) * float((value > 0) - (value < 0))).otherwise(out)
    return df.withColumn(column, out)


def modulate(df: DataFrame, family: str, column: str = "signal", label: str = "regime") -> DataFrame:
    """Family-specific multipliers by regime, clipped to -3..3."""
    factor: Column = F.lit(1.0)
    for name, m in zip(REGIMES, MODULATION.get(family, (1.0,) * 4)):
        factor = F.when(F.col(label) == name, F.lit(m)).otherwise(factor)
    return df.withColumn(column, fr.clip(F.col(column) * factor, -3, 3))


def composite(signals: DataFrame, weights: DataFrame, *, keys=("symbol",)) -> DataFrame:
    """Weighted mean of component signals for each composite_id (weights: composite_id, candidate_id, weight).

    Divided by the sum of absolute weights, clipped to -3..3; fewer than two
    components give zeros.
    """
    j = signals.join(weights, "candidate_id")
    g = j.groupBy("composite_id", *keys, fr.TIME).agg(F.sum(F.col("weight") * F.coalesce("signal", F.lit(0.0))).alias("_s"), F.sum(F.abs("weight")).alias("_w"))
    parts = weights.groupBy("composite_id").agg(F.count(F.lit(1)).alias("_parts"))
    value = F.when(F.col("_parts") >= 2, fr.clip(F.coalesce(fr.divide(F.col("_s"), F.when(F.col("_w") > 0, F.col("_w"))), F.lit(0.0)), -3, 3)).otherwise(F.lit(0.0))
    return g.join(parts, "composite_id").select(F.col("composite_id").alias("candidate_id"), *keys, fr.TIME, value.alias("signal"))


def funding_state(z: Column, usable: Column) -> Column:
    """very_negative, negative, neutral, positive, very_positive, or unavailable."""
    state = F.when(z <= -1.5, "very_negative").when(z <= -0.5, "negative").when(z >= 1.5, "very_positive").when(z >= 0.5, "positive").otherwise("neutral")
    return F.when(usable, state).otherwise("unavailable")


def with_funding_labels(df: DataFrame, z: str = "funding_zscore", keys=fr.KEYS) -> DataFrame:
    x = F.coalesce(F.col(z), F.lit(0.0))
    usable = F.max(F.abs(x)).over(fr.whole(keys)) > 0
    step = x - F.coalesce(F.lag(x).over(fr.line(keys)), x)
    trend = F.when(~usable, "unavailable").when(step > 0.05, "rising").when(step < -0.05, "falling").otherwise("flat")
    return df.withColumns({"funding_state": funding_state(x, usable), "funding_trend": trend})


def empty(signals: DataFrame, column: str = "signal", key: str = "candidate_id") -> DataFrame:
    """Candidates whose signal has no finite value, is zero, or never changes."""
    x = fr.finite(F.col(column))
    g = signals.groupBy(key).agg(F.count(x).alias("n"), F.sum(F.abs(x)).alias("s"), F.stddev_pop(x).alias("d"))
    return g.select(key, ((F.col("n") == 0) | (F.coalesce("s", F.lit(0.0)) < 1e-12) | (F.coalesce("d", F.lit(0.0)) < 1e-12)).alias("empty"))


def correlate(a: DataFrame, b: DataFrame, *, absolute: bool = True) -> DataFrame:
    """Correlation of two long signals by candidate; NULL (absolute) or 1.0 (signed) if degenerate."""
    j = a.join(b.select("candidate_id", "symbol", fr.TIME, F.col("signal").alias("_b")), ["candidate_id", "symbol", fr.TIME])
    r = fr.corr_agg(F.col("signal"), F.col("_b"))
    return j.groupBy("candidate_id").agg((F.abs(r) if absolute else F.coalesce(r, F.lit(1.0))).alias("corr"))


def stack(df: DataFrame, columns: list[str], keys=fr.KEYS) -> DataFrame:
    """Wide signal columns to long (candidate_id, key, time, signal)."""
    return df.unpivot([*keys, fr.TIME], columns, "candidate_id", "signal")
