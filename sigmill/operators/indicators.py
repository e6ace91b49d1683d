"""Technical indicators of one instrument's bars.

Windowed ones are built-in window expressions, in up to four levels of which
each shares one sort; recursive ones (exponential averages) are computed
together in one grouped pass. Denominators of zero give NULL.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.functions import frames as fr

# Default periods.
DEFAULTS = {
    "rsi": (7, 14, 21), "stoch": (14, 21), "stoch_d": 3, "cci": (14, 20), "roc": (5, 10, 20), "willr": (14, 28),
    "macd": ((12, 26, 9), (5, 35, 5)), "sma": (10, 20, 50, 100, 200), "ema": (12, 26, 50, 100), "price_sma_ratio": (20, 50, 100),
    "adx": 14, "aroon": 25, "atr": (14, 20), "bbands": (20, 50), "bb_std": 2.0, "hist_vol": (10, 20, 50), "vol_ratio": (10, 20),
    "mfi": (14, 21), "cmf": (20, 50), "vol_trend_corr": 20, "microstructure": (48, 288), "quote_volume_chg": (12, 48),
    "log_ret": (1, 3, 12, 48, 288), "eff_ratio": (10, 20),
}
GROUPS = ("rsi", "stoch", "cci", "roc", "willr", "macd", "sma", "ema", "price_sma_ratio", "adx", "aroon", "atr", "bbands", "hist_vol", "obv", "mfi", "cmf", "vol_ratio", "vol_trend_corr", "microstructure", "log_ret", "close_position", "hl_ratio", "gap", "intraday_range", "eff_ratio")
# Family, direction and regime by indicator.
_MEANING = {
    ("mean_reversion", "negative_when_high", "range_bound"): "rsi stoch_k stoch_d cci bb_pct close_position",
    ("mean_reversion", "positive", "range_bound"): "willr",
    ("mean_reversion", "negative", "range_bound"): "gap",
    ("trend_following", "positive", "trending"): "roc sma ema price_sma_ratio macd_hist macd_line adx aroon_up log_ret eff_ratio",
    ("trend_following", "negative", "trending"): "aroon_down",
    ("volatility_regime", "neutral", "any"): "atr true_range bb_width hist_vol hl_ratio intraday_range",
    ("volume_confirmation", "positive", "any"): "obv cmf vol_ratio taker_buy_pressure taker_quote_pressure order_flow_imbalance aggressive_buy_volume_z quote_volume_z quote_volume_chg trade_density_z",
    ("volume_confirmation", "negative_when_high", "range_bound"): "mfi",
    ("volume_confirmation", "positive", "trending"): "vol_trend_corr",
}
BARS_A_YEAR_5M = 105_120


def meaning(column: str) -> dict[str, str]:
    """family, direction and regime of a feature column; hybrid, neutral, any if unknown.

    The name is matched without its trailing numbers. ``price_sma_ratio_n``
    is looked up as price_sma, which is not known.
    """
    base = re.sub(r"(_\d+)+$", "", column)
    base = "order_flow_imbalance" if base.startswith("order_flow_imbalance") else base
    base = "price_sma" if base == "price_sma_ratio" else base
    for (family, direction, regime), names in _MEANING.items():
        if base in names.split():
            return {"family": family, "direction": direction, "regime": regime}
    return {"family": "hybrid", "direction": "neutral", "regime": "any"}


def _nz(x: Column) -> Column:
    return F.when(x != 0, x)


def _distance(values: Column, from_: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + F.abs(x - from_))


class _Levels:
    """Columns to add, by the level of windows they need."""

    def __init__(self, keys):
        self.keys = keys
        self.level: list[dict[str, Column]] = [{}, {}, {}, {}]
        self.out: list[str] = []

    def helper(self, level: int, name: str, make: Callable[[], Column]) -> Column:
        if all(name not in x for x in self.level):
            self.level[level][name] = make()
        return F.col(name)

    def add(self, level: int, name: str, column: Column) -> None:
        if name not in self.out:
            self.level[level][name] = column
            self.out.append(name)

    def apply(self, df: DataFrame) -> DataFrame:
        for some in self.level:
            df = df.withColumns(some) if some else df
        return df


def features(bars: DataFrame, include: list[str] | None = None, params: dict | None = None, keys=fr.KEYS) -> tuple[DataFrame, dict[str, dict]]:
    """Add indicator columns (all of GROUPS, or those in ``include``); also what each column means.

    Microstructure columns appear only where the bars have their inputs.
    """
    p = DEFAULTS | (params or {})
    wanted = [g for g in GROUPS if include is None or g in include]
    o, h, l, c, v = (F.col(x).cast("double") for x in ("open", "high", "low", "close", "volume"))  # noqa: E741
    at = fr.line(keys)
    w = lambda n: fr.trailing(n, keys)
    lag = lambda x, n=1: F.lag(x, n).over(at)
    L = _Levels(keys)
    tp = (h + l + c) / 3
    change = lambda: L.helper(0, "_change", lambda: c - lag(c))
    for g in wanted:
        if g == "stoch":
            for n in p["stoch"]:
                low = fr.full(F.min(l), l, n, w(n))
                raw = L.helper(0, f"_k{n}", lambda n=n, low=low: fr.divide(100 * (c - low), _nz(fr.full(F.max(h), h, n, w(n)) - low)))
                L.add(1, f"stoch_k_{n}", fr.mean(raw, 3, w(3)))
                L.add(2, f"stoch_d_{n}", fr.mean(F.col(f"stoch_k_{n}"), p["stoch_d"], w(p["stoch_d"])))
        elif g == "cci":
            t = L.helper(0, "_tp", lambda: tp)
            for n in p["cci"]:
                m = L.helper(1, f"_tp_mean{n}", lambda n=n, t=t: fr.mean(t, n, w(n)))
                values = L.helper(1, f"_tp_list{n}", lambda n=n, t=t: F.collect_list(t).over(w(n)))
                deviation = _distance(values, m) / n
                L.add(2, f"cci_{n}", fr.divide(t - m, _nz(0.015 * deviation)))
        elif g == "roc":
            for n in p["roc"]:
                L.add(0, f"roc_{n}", 100 * (fr.divide(c, lag(c, n)) - 1))
        elif g == "willr":
            for n in p["willr"]:
                top = fr.full(F.max(h), h, n, w(n))
                L.add(0, f"willr_{n}", fr.divide(-100 * (top - c), _nz(top - fr.full(F.min(l), l, n, w(n)))))
        elif g == "sma":
            for n in p["sma"]:
                L.add(0, f"sma_{n}", fr.mean(c, n, w(n)))
        elif g == "price_sma_ratio":
            for n in p["price_sma_ratio"]:
                L.add(0, f"price_sma_ratio_{n}", fr.divide(c, _nz(fr.mean(c, n, w(n)))) - 1)
        elif g == "aroon":
            n = p["aroon"]
            for name, x, pick in (("up", h, F.array_max), ("down", l, F.array_min)):
                values = L.helper(0, f"_aroon_{name}", lambda x=x: F.collect_list(x).over(w(n)))
                first = F.array_position(values, pick(values)) - 1
                L.add(1, f"aroon_{name}_{n}", F.when(F.size(values) == n, 100.0 * (n - first) / n))
        elif g == "bbands":
            for n in p["bbands"]:
                m, s = fr.mean(c, n, w(n)), fr.std(c, n, w(n))
                L.add(0, f"bb_width_{n}", fr.divide(2 * p["bb_std"] * s, _nz(m)))
                L.add(0, f"bb_pct_{n}", fr.divide(c - (m - p["bb_std"] * s), _nz(2 * p["bb_std"] * s)))
        elif g == "hist_vol":
            r = L.helper(0, "_log1", lambda: fr.finite(F.ln(fr.divide(c, lag(c)))))
            for n in p["hist_vol"]:
                L.add(1, f"hist_vol_{n}", fr.std(r, n, w(n)) * F.lit(BARS_A_YEAR_5M**0.5))
        elif g == "obv":
            signed = L.helper(1, "_signed", lambda: F.coalesce(F.signum(change()), F.lit(0.0)) * v)
            change()
            L.add(2, "obv", F.sum(signed).over(fr.running(keys)))
        elif g == "mfi":
            move = L.helper(0, "_tp_move", lambda: tp - lag(tp))
            up = L.helper(1, "_mf_up", lambda: F.when(move > 0, tp * v).otherwise(0.0))
            down = L.helper(1, "_mf_down", lambda: F.when(move < 0, tp * v).otherwise(0.0))
            for n in p["mfi"]:
                ratio = fr.divide(fr.full(F.sum(up), up, n, w(n)), _nz(fr.full(F.sum(down), down, n, w(n))))
                L.add(2, f"mfi_{n}", 100 - fr.divide(F.lit(100.0), 1 + ratio))
        elif g == "cmf":
            flow = L.helper(0, "_clv_flow", lambda: fr.divide((c - l) - (h - c), _nz(h - l)) * v)
            for n in p["cmf"]:
                L.add(1, f"cmf_{n}", fr.divide(fr.full(F.sum(flow), flow, n, w(n)), fr.full(F.sum(v), v, n, w(n))))
        elif g == "vol_ratio":
            for n in p["vol_ratio"]:
                L.add(0, f"vol_ratio_{n}", fr.divide(v, _nz(fr.mean(v, n, w(n)))))
        elif g == "vol_trend_corr":
            n = p["vol_trend_corr"]
            L.add(0, f"vol_trend_corr_{n}", fr.correlation(c, v, n, w(n)))
        elif g == "microstructure" and {"quote_volume", "trade_count", "taker_buy_volume", "taker_buy_quote_volume"} <= set(bars.columns):
            q, buy, buy_q, trades = (F.col(x).cast("double") for x in ("quote_volume", "taker_buy_volume", "taker_buy_quote_volume", "trade_count"))
            pressure = fr.clip(fr.divide(buy, _nz(v)), 0, 1)
            L.add(0, "taker_buy_pressure", pressure)
            L.add(0, "taker_quote_pressure", fr.clip(fr.divide(buy_q, _nz(q)), 0, 1))
            L.add(0, "order_flow_imbalance", fr.clip(2 * pressure - 1, -1, 1))
            density = L.helper(0, "_density", lambda: fr.divide(trades, _nz(q)))
            for n in p["microstructure"]:
                z = lambda x, n=n: fr.zscore(x, n, w(n), max(12, n // 6))
                L.add(1, f"order_flow_imbalance_z_{n}", z(F.col("order_flow_imbalance")))
                L.add(0, f"aggressive_buy_volume_z_{n}", z(buy_q))
                L.add(0, f"quote_volume_z_{n}", z(q))
                L.add(1, f"trade_density_z_{n}", z(density))
            for n in p["quote_volume_chg"]:
                L.add(0, f"quote_volume_chg_{n}", fr.divide(q, lag(q, n)) - 1)
        elif g == "log_ret":
            for n in p["log_ret"]:
                L.add(0, f"log_ret_{n}", fr.finite(F.ln(fr.divide(c, lag(c, n)))))
        elif g == "close_position":
            L.add(0, "close_position", fr.divide(c - l, _nz(h - l)))
        elif g == "hl_ratio":
            L.add(0, "hl_ratio", fr.divide(h, _nz(l)))
        elif g == "gap":
            L.add(0, "gap", fr.divide(o - lag(c), _nz(lag(c))))
        elif g == "intraday_range":
            L.add(0, "intraday_range", fr.divide(h - l, _nz(c)))
        elif g == "eff_ratio":
            moved = L.helper(0, "_abs_change", lambda: F.abs(c - lag(c)))
            for n in p["eff_ratio"]:
                L.add(1, f"eff_ratio_{n}", fr.divide(F.abs(c - lag(c, n)), _nz(fr.full(F.sum(moved), moved, n, w(n)))))
    df = L.apply(bars)
    df = df.drop(*[n for some in L.level for n in some if n.startswith("_")])
    names = recursive_names(wanted, p)
    if names:
        df = recursive(df, wanted, p, keys)
    columns = L.out + names
    return df, {n: meaning(n) for n in columns}


def recursive_names(wanted: list[str], p: dict) -> list[str]:
    out = []
    out += [f"rsi_{n}" for n in p["rsi"]] if "rsi" in wanted else []
    for a, b, s in p["macd"] if "macd" in wanted else ():
        out += [f"macd_hist_{a}_{b}_{s}", f"macd_line_{a}_{b}"]
    out += [f"ema_{n}" for n in p["ema"]] if "ema" in wanted else []
    out += [f"adx_{p['adx']}"] if "adx" in wanted else []
    return out + ([f"atr_{n}" for n in p["atr"]] if "atr" in wanted else [])


def recursive(df: DataFrame, wanted: list[str], p: dict, keys=fr.KEYS) -> DataFrame:
    """RSI, MACD, EMA, ADX and ATR of each instrument in one grouped pass.

    Only key, time and prices cross to Python; a group is one instrument's
    history. The results join back by key and time.
    """
    names = recursive_names(wanted, p)

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(fr.TIME, kind="stable")
        high, low, close = pdf["high"], pdf["low"], pdf["close"]
        smooth = lambda x, a: x.ewm(alpha=a, adjust=False).mean()
        span = lambda x, n: x.ewm(span=n, adjust=False).mean()
        nz = lambda x: x.where(x != 0)
        before = close.shift()
        true_range = pd.concat([high - low, (high - before).abs(), (low - before).abs()], axis=1).max(axis=1)
        out = {}
        move = close.diff()
        for n in p["rsi"] if "rsi" in wanted else ():
            rs = smooth(move.clip(lower=0), 1 / n) / nz(smooth((-move).clip(lower=0), 1 / n))
            out[f"rsi_{n}"] = 100 - 100 / (1 + rs)
        for a, b, s in p["macd"] if "macd" in wanted else ():
            line = span(close, a) - span(close, b)
            out[f"macd_hist_{a}_{b}_{s}"], out[f"macd_line_{a}_{b}"] = line - span(line, s), line
        for n in p["ema"] if "ema" in wanted else ():
            out[f"ema_{n}"] = span(close, n)
        if "adx" in wanted:
            a = 1 / p["adx"]
            up, down = high.diff(), -low.diff()
            average = nz(smooth(true_range, a))
            plus = 100 * smooth(up.where((up > 0) & (up > down), 0.0), a) / average
            minus = 100 * smooth(down.where((down > 0) & (down > up), 0.0), a) / average
            out[f"adx_{p['adx']}"] = smooth(100 * (plus - minus).abs() / nz(plus + minus), a)
        for n in p["atr"] if "atr" in wanted else ():
            out[f"atr_{n}"] = smooth(true_range, 1 / n)
        return pd.DataFrame({**{k: pdf[k] for k in [*keys, fr.TIME]}, **{n: out[n] for n in names}})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in [*keys, fr.TIME]] + [f"`{n}` double" for n in names])
    own = df.select(*keys, fr.TIME, *[F.col(x).cast("double").alias(x) for x in ("high", "low", "close")])
    got = own.groupBy(*keys).applyInPandas(run, schema)
    return df.join(got, [*keys, fr.TIME])


def true_range(keys=fr.KEYS) -> Column:
    before = F.lag("close").over(fr.line(keys))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def forward_return(h: int, *, log: bool = False, price: str = "close", keys=fr.KEYS) -> Column:
    later = fr.divide(F.lead(price, h).over(fr.line(keys)), F.col(price))
    return fr.finite(F.ln(later)) if log else later - 1


def supplemental(bars: DataFrame, series: dict[str, DataFrame], *, z: int = 288, change: int = 12, keys=fr.KEYS) -> DataFrame:
    """As-of joined series (each: key, open_time, value) with <name>, <name>_z, <name>_change."""
    from .joins import as_of

    for name, s in series.items():
        bars = as_of(bars, s, "value", event_time=fr.TIME, name=name, keys=keys)
    at = fr.line(keys)
    more = {}
    for name in series:
        x = F.col(name)
        more[f"{name}_z"] = fr.zscore(x, z, fr.trailing(z, keys), max(12, z // 6))
        more[f"{name}_change"] = fr.divide(x, F.lag(x, change).over(at)) - 1
    return bars.withColumns(more)
