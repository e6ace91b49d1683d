"""Null-safe arithmetic and row frames over one instrument's bars.

Missing is NULL, never NaN. A frame of n rows is "full" only with n non-null
values; frames count rows, not time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Bars are keyed by these; every time-series operator works within a key.
KEYS = ("symbol",)
TIME = "open_time"


def line(keys=KEYS, time: str = TIME) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(time)


def trailing(n: int, keys=KEYS, time: str = TIME) -> WindowSpec:
    return line(keys, time).rowsBetween(-(n - 1), 0)


def running(keys=KEYS, time: str = TIME) -> WindowSpec:
    return line(keys, time).rowsBetween(Window.unboundedPreceding, 0)


def whole(keys=KEYS) -> WindowSpec:
    return Window.partitionBy(*keys)


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def full(aggregate: Column, x: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    """``aggregate`` over ``w`` where the frame has ``least`` (default n) non-null values of x."""
    return F.when(F.count(x).over(w) >= (n if least is None else least), aggregate.over(w))


def mean(x, n, w, least=None):
    return full(F.avg(x), x, n, w, least)


def std(x, n, w, least=None):
    return full(F.stddev_samp(x), x, n, w, least)


def zscore(x, n, w, least=None):
    s = std(x, n, w, least)
    return divide(x - mean(x, n, w, least), F.when(s > 0, s))


def correlation(x: Column, y: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    """Pearson over pairs; NULL for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    sx, sy = F.stddev_pop(a).over(w), F.stddev_pop(b).over(w)
    r = divide(F.covar_pop(a, b).over(w), F.when((sx > 1e-14) & (sy > 1e-14), sx * sy))
    return F.when(F.count(F.when(both, F.lit(1))).over(w) >= (n if least is None else least), r)


def corr_agg(x: Column, y: Column) -> Column:
    """Pearson as an aggregate; NULL for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    s = F.stddev_pop(a) * F.stddev_pop(b)
    return divide(F.covar_pop(a, b), F.when(s > 1e-28, s))


def average_rank(x: Column, *partition: str | Column) -> Column:
    """Rank from 1 within the partition, ties sharing their mean; NULL stays NULL."""
    p = [*partition, x.isNull()]
    order = Window.partitionBy(*p).orderBy(x)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*p, x))
    return F.when(x.isNotNull(), F.rank().over(order) + (ties - 1) / 2)


def clip(x: Column, low: float, high: float) -> Column:
    """NULL stays NULL (least and greatest alone would drop it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def tanh(x: Column) -> Column:
    return F.tanh(x)


def round_zero(x: Column, digits: int) -> Column:
    """Rounded, without negative zero; for comparing engines."""
    return F.round(x, digits) + F.lit(0.0)


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))
