"""Signals to positions, costs, returns and metrics, for many candidates in one plan.

Everything is long: (candidate_id, symbol, open_time). What can be a window is
one; the state machines of a candidate (hysteresis, buffer, exits) run in one
grouped pass, so its rows cross to Python once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigmill.functions import frames as fr
from sigmill.sources.bars import bars_per_year

KEYS = ("candidate_id", "symbol")


@dataclass(frozen=True)
class Costs:
    taker_bps: float = 5.0
    slippage_base_bps: float = 1.0
    slippage_k: float = 25.0
    slippage_gamma: float = 0.5
    notional_usd: float = 10_000.0


SPOT = Costs(taker_bps=10.0)


@dataclass(frozen=True)
class Sizing:
    interval: str = "5m"
    target_vol: float = 0.15
    window_days: int = 30
    most_leverage: float = 3.0
    least_rows: int = 10

    @property
    def window(self) -> int:
        return max(2, int(self.window_days * max(1.0, bars_per_year(self.interval) / 365)))


@dataclass(frozen=True)
class Rules:
    """Position rules of a candidate; the defaults switch exits off."""

    entry_band: float = 0.0
    exit_band: float = 0.0
    buffer: float = 0.05
    stop_loss: float = 0.0
    most_bars: int = 0
    tiers: tuple[tuple[float, float], ...] = ()
    trailing: float = 0.0
    trail_after_tier: bool = True
    side: str = "both"


def hysteresis(signal: np.ndarray, enter: float, leave: float) -> np.ndarray:
    """Flat until |signal| reaches ``enter``, then the signal until |signal| falls to ``leave``."""
    if enter <= 0 and leave <= 0:
        return signal
    leave = min(leave, enter)
    size = np.abs(signal)
    out, held = np.zeros(len(signal)), False
    for i in range(len(signal)):
        held = size[i] > leave if held else size[i] >= enter
        if held:
            out[i] = signal[i]
    return out


def buffered(target: np.ndarray, least: float) -> np.ndarray:
    """Follow the target only when it is more than ``least`` away."""
    out, now = np.empty(len(target)), 0.0
    for i, t in enumerate(target):
        if abs(t - now) > least:
            now = t
        out[i] = now
    return out


class _Trade:
    """One run of same-sign position under exit rules."""

    def __init__(self, sign: float, trailing: bool):
        self.sign, self.trailing = sign, trailing
        self.own = self.full = self.peak = 0.0
        self.bars, self.scale = 0, 1.0
        self.open_tiers: list[tuple[float, float]] | None = None


def exits(position: np.ndarray, returns: np.ndarray, rules: Rules) -> np.ndarray:
    """Override positions by maximum age, stop loss, trailing stop and profit tiers.

    Per bar: a blocked sign stays flat; the last bar's profit is booked; the
    trade ends by age, stop or trail (the latter two block the same sign until
    the signal is flat or flips), or because the signal is flat; a flip starts
    anew; tiers scale what is left; a position without a trade starts one.
    """
    tiers = sorted(rules.tiers)
    if not (rules.stop_loss < 0 or rules.most_bars > 0 or tiers or rules.trailing > 0):
        return position
    out, trade, blocked = position.copy(), None, 0.0
    for i, want in enumerate(position):
        sign = float(np.sign(want))
        if blocked and sign == blocked:
            out[i] = 0.0
            continue
        blocked = 0.0
        if trade is not None and i:
            r = returns[i - 1]
            if np.isfinite(r):
                trade.own += out[i - 1] * r
                trade.full += position[i - 1] * r
                trade.bars += 1
                trade.peak = max(trade.peak, trade.own)
            lost = rules.stop_loss < 0 and trade.own < rules.stop_loss
            lost |= trade.trailing and rules.trailing > 0 and trade.own < trade.peak - rules.trailing
            if lost or 0 < rules.most_bars <= trade.bars:
                blocked = sign if lost and sign == trade.sign else 0.0
                out[i], trade = 0.0, None
                continue
            if not sign:
                out[i], trade = 0.0, None
                continue
            if sign == trade.sign:
                still = []
                for level, part in trade.open_tiers if trade.open_tiers is not None else tiers:
                    if trade.full < level:
                        still.append((level, part))
                        continue
                    trade.scale *= 1 - part
                    if rules.trail_after_tier and not trade.trailing:
                        trade.trailing, trade.peak = True, trade.own
                trade.open_tiers = still
                out[i] = want * trade.scale
            else:
                trade = None
        if trade is None and abs(want) > 1e-8:
            trade = _Trade(sign, not rules.trail_after_tier)
            out[i] = want
    return out


def prepare(signals: DataFrame, bars: DataFrame, sizing: Sizing, side: str = "both") -> DataFrame:
    """Join bars and signals; add open_return, executable (the signal one bar late) and leverage."""
    b = bars.select("symbol", fr.TIME, "open", "quote_volume")
    at = fr.line(("symbol",))
    b = b.withColumn("open_return", fr.divide(F.lead("open").over(at), F.col("open")) - 1)
    b = b.withColumn("_known", F.lag("open_return", 2).over(at))
    vol = fr.std(F.col("_known"), sizing.window, fr.trailing(sizing.window, ("symbol",)), sizing.least_rows) * F.lit(bars_per_year(sizing.interval) ** 0.5)
    b = b.withColumn("_vol", vol)
    b = b.withColumn("leverage", F.coalesce(fr.clip(fr.divide(F.lit(sizing.target_vol), F.when(F.col("_vol") > 0, F.col("_vol"))), 0.0, sizing.most_leverage), F.lit(0.0)))
    low, high = (0.0 if side == "long_only" else -1.0), (0.0 if side == "short_only" else 1.0)
    s = F.coalesce(fr.clip(F.col("signal"), low, high), F.lit(0.0))
    joined = b.drop("_known", "_vol").join(signals.select("candidate_id", "symbol", fr.TIME, s.alias("signal")), ["symbol", fr.TIME])
    return joined.withColumn("executable", F.coalesce(F.lag("signal").over(fr.line(KEYS)), F.lit(0.0)))


def positions(prepared: DataFrame, rules: Rules) -> DataFrame:
    """Add position (volatility-targeted) and fixed_position."""
    schema = "candidate_id {}, symbol string, open_time long, position double, fixed_position double".format(dict(prepared.dtypes)["candidate_id"])

    def run(pdf):
        pdf = pdf.sort_values(fr.TIME, kind="stable")
        s = hysteresis(pdf["executable"].to_numpy(float), rules.entry_band, rules.exit_band)
        r = pdf["open_return"].to_numpy(float)
        target = s * pdf["leverage"].to_numpy(float)
        out = pdf[["candidate_id", "symbol", fr.TIME]].copy()
        out["position"] = exits(buffered(target, rules.buffer), r, rules)
        out["fixed_position"] = exits(buffered(s, rules.buffer), r, rules)
        return out

    own = prepared.select("candidate_id", "symbol", fr.TIME, "executable", "leverage", "open_return")
    return prepared.join(own.groupBy(*KEYS).applyInPandas(run, schema), ["candidate_id", "symbol", fr.TIME])


def strategy_returns(df: DataFrame, costs: Costs = Costs(), position: str = "position") -> DataFrame:
    """Add turnover, participation, cost and net_return; ``flow`` (funding landing on the bar) counts if there."""
    p = F.col(position)
    turnover = F.abs(p - F.coalesce(F.lag(position).over(fr.line(KEYS)), F.lit(0.0)))
    df = df.withColumn("turnover", turnover)
    df = df.withColumn("participation", F.coalesce(fr.divide(costs.notional_usd * F.col("turnover"), F.when(F.col("quote_volume") != 0, F.col("quote_volume"))), F.lit(0.0)))
    slip = costs.slippage_base_bps + costs.slippage_k * F.pow(F.greatest(F.lit(0.0), F.col("participation")), F.lit(costs.slippage_gamma))
    df = df.withColumn("cost", F.col("turnover") * (costs.taker_bps + slip) / 10_000)
    flow = -p * F.col("flow") if "flow" in df.columns else F.lit(0.0)
    gross = p * F.coalesce("open_return", F.lit(0.0)) + flow
    return df.withColumns({"gross_return": gross, "net_return": gross - F.col("cost")})


def trade_flag(position: str = "position"):
    return F.abs(F.col(position) - F.coalesce(F.lag(position).over(fr.line(KEYS)), F.lit(0.0))) > 1e-12


def metrics(df: DataFrame, keys: tuple[str, ...] = KEYS, *, returns: str = "net_return", year: float = 105_120.0, notional: float = 10_000.0, time: str = fr.TIME) -> DataFrame:
    """total_return, annualized_return, annualized_vol, sharpe, max_drawdown, calmar, trade_count, pnl of each key.

    Equity compounds from 1; drawdowns are below its running maximum.
    """
    r = F.coalesce(F.col(returns), F.lit(0.0))
    order = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    e = df.withColumn("_r", r).withColumn("_equity", F.product(1 + F.col("_r")).over(order))
    e = e.withColumn("_drawdown", fr.divide(F.col("_equity"), F.max("_equity").over(order)) - 1)
    trades = F.count_if(F.col("turnover") > 1e-12) if "turnover" in df.columns else F.lit(0)
    g = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.product(1 + F.col("_r")).alias("_end"), F.avg("_r").alias("_mean"), F.stddev_samp("_r").alias("_std"),
        F.min("_drawdown").alias("max_drawdown"), trades.cast("long").alias("trade_count"), (F.sum("_r") * notional).alias("pnl"),
    )
    end, n = F.col("_end"), F.col("n")
    annual = F.when(end > 0, F.pow(end, F.lit(year) / n) - 1).otherwise(F.lit(-1.0))
    s = F.when(F.col("_std") > 1e-12, F.col("_std"))
    out = g.select(
        *keys, "n", (end - 1).alias("total_return"), annual.alias("annualized_return"), F.coalesce(F.col("_std") * F.lit(year**0.5), F.lit(0.0)).alias("annualized_vol"),
        F.coalesce(fr.divide(F.col("_mean"), s) * F.lit(year**0.5), F.lit(0.0)).alias("sharpe"), F.least(F.col("max_drawdown"), F.lit(0.0)).alias("max_drawdown"), "trade_count", "pnl",
    )
    calmar = F.coalesce(fr.divide(F.col("annualized_return"), F.abs(F.when(F.col("max_drawdown") < 0, F.col("max_drawdown")))), F.lit(0.0))
    return out.withColumn("calmar", calmar)


def regime_metrics(df: DataFrame, regime: str, **how) -> DataFrame:
    return metrics(df, (*KEYS, regime), **how)


def cost_summary(df: DataFrame, costs: Costs = Costs(), keys=KEYS) -> DataFrame:
    """Turnover-weighted realised bps, mean participation, turnover and the cost at which profit ends."""
    g = df.groupBy(*keys).agg(F.sum("turnover").alias("turnover"), F.sum("cost").alias("total_cost"), F.sum("net_return").alias("_net"), F.avg("participation").alias("avg_participation"))
    t = F.when(F.col("turnover") > 0, F.col("turnover"))
    realised = F.coalesce(fr.divide(F.col("total_cost"), t) * 10_000, F.lit(costs.taker_bps + costs.slippage_base_bps))
    even = F.coalesce(F.greatest(F.lit(0.0), fr.divide(F.col("_net") + F.col("total_cost"), t) * 10_000), F.lit(0.0))
    return g.select(*keys, "turnover", "total_cost", "avg_participation", realised.alias("actual_cost_bps"), even.alias("break_even_bps"))


def holding(df: DataFrame, position: str = "position", keys=KEYS) -> DataFrame:
    """avg_holding: mean length of runs with a position (0 without any)."""
    on = F.abs(F.col(position)) > 1e-12
    start = on & ~F.coalesce(F.lag(on).over(fr.line(keys)), F.lit(False))
    runs = df.select(*keys, fr.TIME, on.alias("on"), start.cast("int").alias("start"))
    g = runs.groupBy(*keys).agg(F.count_if("on").alias("bars"), F.sum("start").alias("runs"))
    return g.select(*keys, F.coalesce(fr.divide(F.col("bars").cast("double"), F.when(F.col("runs") > 0, F.col("runs"))), F.lit(0.0)).alias("avg_holding"), "runs")


def window_stability(df: DataFrame, *, windows: int = 4, year: float = 105_120.0, returns: str = "net_return", keys=KEYS) -> tuple[DataFrame, DataFrame]:
    """Equal chronological slices: metrics of each, and mean, spread, shares and score of their Sharpe ratios."""
    windows = max(2, windows)
    p = df.withColumns({"_rn": F.row_number().over(fr.line(keys)) - 1, "_n": F.count(F.lit(1)).over(fr.whole(keys))}).where(F.col("_n") >= windows)
    slice_ = F.least(F.floor(F.col("_rn") / F.floor(F.col("_n") / windows)), F.lit(windows - 1)).cast("int")
    per = metrics(p.withColumn("window_index", slice_), (*keys, "window_index"), returns=returns, year=year)
    g = per.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("n_windows"), F.avg("sharpe").alias("sharpe_mean"), F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)).alias("sharpe_std"),
        F.avg((F.col("sharpe") > 0).cast("double")).alias("positive_rate"), F.avg((F.col("trade_count") > 0).cast("double")).alias("trade_coverage"),
    )
    score = F.when(F.col("sharpe_mean") <= 0, F.lit(0.0)).otherwise(fr.clip(F.col("positive_rate") * F.col("sharpe_mean") / (1 + F.col("sharpe_std")), 0, 1))
    return per, g.withColumn("stability_score", score)


def equity_curve(df: DataFrame, *, points: int = 512, returns: str = "net_return", keys=KEYS) -> DataFrame:
    """At most ``points`` rows of compounded equity for each key, first and last included."""
    e = df.withColumn("equity", F.product(1 + F.coalesce(F.col(returns), F.lit(0.0))).over(fr.running(keys)))
    e = e.withColumns({"_rn": F.row_number().over(fr.line(keys)) - 1, "_n": F.count(F.lit(1)).over(fr.whole(keys))})
    # the place of point k is round(k * (n - 1) / (points - 1)): keep a row if some k lands on it
    last, step = F.col("_n") - 1, F.lit(points - 1)
    k = F.bround(F.col("_rn") * step / F.greatest(last, F.lit(1)))
    keep = (F.col("_n") <= points) | (F.bround(k * last / step) == F.col("_rn"))
    return e.where(keep).select(*keys, fr.TIME, "equity")


def trade_events(df: DataFrame, *, last: int = 500, position: str = "position", keys=KEYS) -> DataFrame:
    """The last trades of each key: time, side, change, position."""
    before = F.coalesce(F.lag(position).over(fr.line(keys)), F.lit(0.0))
    t = df.withColumn("change", F.col(position) - before).where(F.abs("change") > 1e-12)
    t = t.withColumn("side", F.when(F.col("change") > 0, "buy").otherwise("sell"))
    w = Window.partitionBy(*keys).orderBy(F.col(fr.TIME).desc())
    return t.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last).select(*keys, fr.TIME, "side", "change", F.col(position).alias("position"))


def capacity(bars: DataFrame, *, days: int = 30, bars_a_day: int = 288, share: float = 0.01, keys=fr.KEYS) -> DataFrame:
    """Mean daily turnover of the last ``days``, and the share of it that can be traded."""
    w = Window.partitionBy(*keys).orderBy(F.col(fr.TIME).desc())
    recent = bars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= days * bars_a_day)
    adv = F.sum("quote_volume") / F.greatest(F.lit(1.0), F.count(F.lit(1)) / float(bars_a_day))
    return recent.groupBy(*keys).agg(adv.alias("adv")).withColumn("capacity_usd", F.col("adv") * share)


def backtest(signals: DataFrame, bars: DataFrame, *, sizing: Sizing = Sizing(), rules: Rules = Rules(), costs: Costs = Costs(), funding: DataFrame | None = None) -> DataFrame:
    """Bars of every candidate with position, turnover, cost and net_return."""
    if funding is not None:
        from .joins import as_of_forward_sum

        flows = as_of_forward_sum(bars, funding, "last_funding_rate").select("symbol", fr.TIME, "flow")
    p = positions(prepare(signals, bars, sizing, rules.side), rules)
    if funding is not None:
        p = p.join(flows, ["symbol", fr.TIME], "left").fillna(0.0, ["flow"])
    return strategy_returns(p, costs)
