"""Cross-sectional operators on a long panel (open_time, symbol, factor, fwd_ret, in_universe).

A panel is never pivoted; work across instruments is a window over open_time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmill.functions import frames as fr

from .joins import densify


def build_panel(bars: DataFrame, factor: str, *, horizon: int = 1, listed: DataFrame | None = None) -> DataFrame:
    """Factor, forward open-to-open return over ``horizon`` bars, and universe membership.

    ``listed`` (symbol, listed_ms): a symbol is out before its listing. Values
    outside the universe or missing stay NULL, never 0.
    """
    at = fr.line()
    p = bars.withColumn("fwd_ret", fr.divide(F.lead("open", horizon + 1).over(at), F.lead("open", 1).over(at)) - 1)
    if listed is not None:
        p = p.join(listed, "symbol", "left").withColumn("_in", F.coalesce(F.col(fr.TIME) >= F.col("listed_ms"), F.lit(True)))
    else:
        p = p.withColumn("_in", F.lit(True))
    f = fr.finite(F.col(factor).cast("double"))
    inside = F.col("_in") & f.isNotNull()
    return p.select(fr.TIME, "symbol", F.when(F.col("_in"), f).alias("factor"), F.when(F.col("_in"), F.col("fwd_ret")).alias("fwd_ret"), inside.alias("in_universe"))


def universe_size(panel: DataFrame) -> DataFrame:
    return panel.groupBy(fr.TIME).agg(F.count_if("in_universe").alias("members"))


def _members(column: str = "factor") -> Column:
    return F.when(F.col("in_universe"), F.col(column))


def zscore(panel: DataFrame, name: str = "z") -> DataFrame:
    """Population z-score across members; 0 outside the universe and without spread."""
    w = Window.partitionBy(fr.TIME)
    x = _members()
    s = F.stddev_pop(x).over(w)
    return panel.withColumn(name, F.coalesce(fr.divide(x - F.avg(x).over(w), F.when(s > 1e-14, s)), F.lit(0.0)))


def rank_weights(panel: DataFrame, name: str = "weight") -> DataFrame:
    """Centred ordinal ranks (ties by symbol), scaled so that absolute weights add up to 1.

    Net weight is 0; fewer than two members all get 0.
    """
    inside = F.col("in_universe") & F.col("factor").isNotNull()
    p = panel.withColumn("_ok", inside)
    r = F.row_number().over(Window.partitionBy(fr.TIME, "_ok").orderBy("factor", "symbol"))
    n = F.count(F.lit(1)).over(Window.partitionBy(fr.TIME, "_ok"))
    p = p.withColumn("_c", F.when(F.col("_ok") & (n >= 2), r - (n + 1) / 2))
    total = F.sum(F.abs("_c")).over(Window.partitionBy(fr.TIME))
    return p.withColumn(name, F.coalesce(fr.divide(F.col("_c"), total), F.lit(0.0))).drop("_ok", "_c")


def quantile_weights(panel: DataFrame, share: float = 0.2, name: str = "weight") -> DataFrame:
    """+0.5/k for the k highest members and -0.5/k for the k lowest, k = max(1, floor(n * share))."""
    p = panel.withColumn("_ok", F.col("in_universe") & F.col("factor").isNotNull())
    w = Window.partitionBy(fr.TIME, "_ok")
    n = F.count(F.lit(1)).over(w)
    k = F.greatest(F.lit(1), F.floor(n * F.lit(share)))
    low, high = F.row_number().over(w.orderBy("factor", "symbol")), F.row_number().over(w.orderBy(F.col("factor").desc(), F.col("symbol").desc()))
    value = F.when(high <= k, F.lit(0.5) / k).when(low <= k, F.lit(-0.5) / k).otherwise(F.lit(0.0))
    return p.withColumn(name, F.when(F.col("_ok") & (n >= 2), value).otherwise(F.lit(0.0))).drop("_ok")


def hold(panel: DataFrame, every: int, name: str = "weight") -> DataFrame:
    """Weights of each rebalance (every ``every`` times) carried on; a name that leaves is 0 until the next."""
    times = panel.select(fr.TIME).distinct()
    number = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(fr.TIME)) - 1
    times = times.withColumn("_block", F.floor(number / every)).withColumn("_first", number % every == 0)
    p = panel.join(times, fr.TIME)
    block = Window.partitionBy("symbol", "_block").orderBy(fr.TIME)
    upto = block.rowsBetween(Window.unboundedPreceding, 0)
    start = F.first(F.when(F.col("_first"), F.col(name)), ignorenulls=True).over(upto)
    stayed = F.min(F.col("in_universe").cast("int")).over(upto) == 1
    return p.withColumn(name, F.when(stayed, F.coalesce(start, F.lit(0.0))).otherwise(F.lit(0.0))).drop("_block", "_first")


def long_short(weighted: DataFrame, *, cost_bps: float = 6.0, name: str = "weight") -> DataFrame:
    """Per time: gross = sum of weight * forward return, turnover, cost, net_return."""
    before = F.coalesce(F.lag(name).over(fr.line(("symbol",))), F.lit(0.0))
    moved = weighted.withColumn("_move", F.abs(F.col(name) - before))
    g = moved.groupBy(fr.TIME).agg(F.sum(F.col(name) * F.coalesce("fwd_ret", F.lit(0.0))).alias("gross"), F.sum("_move").alias("turnover"), F.count_if("in_universe").alias("members"))
    return g.withColumn("cost", F.col("turnover") * cost_bps / 10_000).withColumn("net_return", F.col("gross") - F.col("cost"))


def ic(panel: DataFrame, *, method: str = "spearman", least: int = 3) -> DataFrame:
    """Per time: correlation of factor and forward return over members, with at least ``least`` of them."""
    p = panel.where("in_universe and factor is not null and fwd_ret is not null")
    if method == "spearman":
        p = p.select(fr.TIME, fr.average_rank(F.col("factor"), fr.TIME).alias("x"), fr.average_rank(F.col("fwd_ret"), fr.TIME).alias("y"))
    else:
        p = p.select(fr.TIME, F.col("factor").alias("x"), F.col("fwd_ret").alias("y"))
    g = p.groupBy(fr.TIME).agg(F.count(F.lit(1)).alias("n"), fr.corr_agg(F.col("x"), F.col("y")).alias("ic"))
    return g.withColumn("ic", F.when(F.col("n") >= least, F.col("ic")))


def ic_summary(series: DataFrame) -> DataFrame:
    """mean, vol, t (Newey-West), hit rate and n of an IC series."""
    from .inference import newey_west

    s = series.where("ic is not null").withColumn("_all", F.lit("all"))
    base = s.groupBy("_all").agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_vol"), F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("n"))
    return base.join(newey_west(s, "ic", keys=("_all",)).drop("n"), "_all").drop("_all")


def pnl_matrix(pnl: DataFrame) -> DataFrame:
    """(factor_id, open_time, net_return) made complete: missing pairs are 0."""
    return densify(pnl.select("factor_id", fr.TIME, "net_return"), "factor_id", fr.TIME, ["net_return"])
