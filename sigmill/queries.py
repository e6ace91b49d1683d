"""Registered queries on the test tables, each with SQL that must give the same rows.

Bars come from ``events``: an instrument is an event type, a bar an hour.
Doubles are rounded in both engines before they are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.functions import frames as fr
from sigmill.operators import evidence, indicators, inference, joins, ledger, panel, quality, regime, rules, search, signals, simulate
from sigmill.plans import expr, methods
from sigmill.sources import bars as src

DIGITS = 6
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = src.bars_from_ticks(table(spark, sf_dir, "events"), key="event_type", time="ts", price="value", tie="event_id")
    return src.with_defaults(b)


BARS = """bars AS (SELECT event_type AS symbol, CAST(epoch_ms(date_trunc('hour', ts)) AS BIGINT) AS open_time,
first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
CAST(count(*) AS DOUBLE) AS volume, sum(value) AS quote_volume, count(*) AS trade_count FROM events GROUP BY 1, 2)"""
AT = "PARTITION BY symbol ORDER BY open_time"


def rows(n: int) -> str:
    return f"({AT} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {rows(n)} >= {least or n} THEN {agg}({x}) OVER {rows(n)} END"


def z(x: str, n: int, least: int | None = None) -> str:
    return f"(({x}) - ({full('avg', x, n, least)})) / nullif({full('stddev_samp', x, n, least)}, 0)"


def register(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def shown(df: DataFrame, *columns: str, keys=("symbol", "open_time"), digits: int = DIGITS) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*keys, *[fr.round_zero(F.col(c), digits).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def out(columns: dict[str, str], source: str, ctes: str = "", digits: int = DIGITS) -> str:
    """SELECT of keys and rounded columns over the bars (and more CTEs)."""
    inner = ", ".join(f"round(CAST({e} AS DOUBLE), {digits}) + 0.0 AS {c}" for c, e in columns.items())
    return f"WITH {BARS}{', ' + ctes if ctes else ''} SELECT symbol, open_time, {inner} FROM {source}"


# ---- expressions ----------------------------------------------------------


def _expression(name: str, text: str, sql: str, ctes: str = "", source: str = "bars", cross: bool = False) -> None:
    def run(spark, sf_dir):
        tree = expr.canonicalize(expr.parse(text, cross_sectional=cross))
        return shown(expr.evaluate(hourly(spark, sf_dir), {"value": tree}), "value")

    QUERIES[f"dsl_{name}"] = run
    ORACLES[f"dsl_{name}"] = out({"value": sql}, source, ctes)


_flag = lambda c: f"CAST(coalesce({c}, false) AS DOUBLE)"
_ret = "r AS (SELECT *, ln(close / nullif(lag(close) OVER ({0}), 0)) AS returns FROM bars)".format(AT)
for _name, _text, _sql in [
    ("add", "$close + $open", "close + open"),
    ("subtract", "$high - $low", "high - low"),
    ("multiply", "$close * $volume", "close * volume"),
    ("divide", "$close / ($high - $low)", "close / nullif(high - low, 0)"),
    ("abs", "ABS($close - $open)", "abs(close - open)"),
    ("sign", "SIGN($close - $open)", "sign(close - open)"),
    ("log", "LOG($close - $open)", "CASE WHEN close - open > 0 THEN ln(close - open) END"),
    ("sqrt", "SQRT($close - $open)", "CASE WHEN close - open >= 0 THEN sqrt(close - open) END"),
    ("neg", "-$close", "-close"),
    ("eq", "$open == $high", _flag("open = high")),
    ("gt", "$close > $open", _flag("close > open")),
    ("lt", "$close < $open", _flag("close < open")),
    ("and", "$close > $open and $volume > 2", _flag("close > open AND volume > 2")),
    ("or", "$close > $open or $volume > 2", _flag("close > open OR volume > 2")),
    ("not", "not ($close > $open)", _flag("NOT (close > open)")),
    ("where", "WHERE($close > $open, $high, -$low)", "CASE WHEN close > open THEN high ELSE -low END"),
    ("delay", "DELAY($close, 3)", f"lag(close, 3) OVER ({AT})"),
    ("delta", "DELTA($close, 5)", f"close - lag(close, 5) OVER ({AT})"),
    ("ts_pctchange", "TS_PCTCHANGE($close, 5)", f"close / nullif(lag(close, 5) OVER ({AT}), 0) - 1"),
    ("ts_mean", "TS_MEAN($close, 20)", full("avg", "close", 20)),
    ("ts_std", "TS_STD($close, 20)", full("stddev_samp", "close", 20)),
    ("ts_max", "TS_MAX($high, 10)", full("max", "high", 10)),
    ("ts_min", "TS_MIN($low, 10)", full("min", "low", 10)),
    ("ts_zscore", "TS_ZSCORE($close, 20)", z("close", 20)),
    ("ts_corr", "TS_CORR($close, $volume, 20)", f"CASE WHEN count(*) OVER {rows(20)} = 20 THEN covar_pop(close, volume) OVER {rows(20)} / nullif(CASE WHEN stddev_pop(close) OVER {rows(20)} > 1e-14 THEN stddev_pop(close) OVER {rows(20)} END * CASE WHEN stddev_pop(volume) OVER {rows(20)} > 1e-14 THEN stddev_pop(volume) OVER {rows(20)} END, 0) END"),
]:
    _expression(_name, _text, _sql)
_expression("ts_rank", "TS_RANK($close, 10)", "CASE WHEN len(l) = 10 THEN (len(list_filter(l, lambda v: v <= close)) - 1) / 9.0 END", f"l AS (SELECT *, list(close) OVER {rows(10)} AS l FROM bars)", "l")
_expression("returns", "TS_MEAN($returns, 5)", full("avg", "returns", 5), _ret, "r")
_expression("nested", "TS_ZSCORE(DELTA(TS_MEAN($close, 5), 3), 20)", z("d", 20), f"a AS (SELECT *, {full('avg', 'close', 5)} AS m FROM bars), b AS (SELECT *, m - lag(m, 3) OVER ({AT}) AS d FROM a)", "b")
_expression("rank", "RANK($close)", "(rank() OVER (PARTITION BY open_time ORDER BY close) + (count(*) OVER (PARTITION BY open_time, close) - 1) / 2.0) / count(*) OVER (PARTITION BY open_time)", cross=True)
_expression("zscore", "ZSCORE($close)", "(close - avg(close) OVER (PARTITION BY open_time)) / nullif(stddev_pop(close) OVER (PARTITION BY open_time), 0)", cross=True)
_expression("scale", "SCALE($close)", "close / nullif(sum(abs(close)) OVER (PARTITION BY open_time), 0)", cross=True)


# ---- scans, quality, splits ----------------------------------------------


@register("bars_hourly", f"WITH {BARS} SELECT symbol, open_time, round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(close, 6) + 0.0 AS close, volume, round(quote_volume, 6) + 0.0 AS quote_volume, trade_count FROM bars")
def bars_hourly(spark, sf_dir):
    return shown(hourly(spark, sf_dir), "open", "high", "low", "close", "volume", "quote_volume", "trade_count")


@register("tail_n", f"WITH {BARS} SELECT symbol, open_time, round(close, 6) + 0.0 AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS n FROM bars) WHERE n <= 50")
def tail_n(spark, sf_dir):
    return shown(src.tail(hourly(spark, sf_dir), 50), "close")


@register("data_extent", f"WITH {BARS} SELECT symbol, min(open_time) AS first_ms, max(open_time) AS last_ms, count(*) AS rows FROM bars GROUP BY 1")
def data_extent(spark, sf_dir):
    return src.extent(hourly(spark, sf_dir)).drop("content_hash")


_STEP = f"s AS (SELECT *, lag(close) OVER ({AT}) AS before, open_time - lag(open_time) OVER ({AT}) AS gap FROM bars)"
_CHECKS = {
    "duplicates": "0", "negative_values": "count_if(open < 0 OR high < 0 OR low < 0 OR close < 0 OR volume < 0 OR quote_volume < 0)",
    "ohlc_invariant": "count_if(high < greatest(open, close)) + count_if(low > least(open, close))", "zero_volume": "count_if(volume = 0)",
    "close_jump": "count_if(abs(close / nullif(before, 0) - 1) > 0.10)", "gaps": "count_if(gap > 3600000)",
}


@register("quality_checks", f"WITH {BARS}, {_STEP}, c AS (" + " UNION ALL ".join(f"SELECT symbol, '{k}' AS check_name, CAST({v} AS BIGINT) AS count, count(*) AS n FROM s GROUP BY 1" for k, v in _CHECKS.items()) + ") SELECT symbol, check_name, count, round(count / n, 6) + 0.0 AS ratio, CASE WHEN CASE WHEN check_name = 'zero_volume' THEN count / n > 0.01 ELSE count > 0 END THEN CASE WHEN check_name IN ('negative_values', 'ohlc_invariant') THEN 'fail' ELSE 'warn' END ELSE 'pass' END AS status FROM c")
def quality_checks(spark, sf_dir):
    return shown(quality.quality_checks(hourly(spark, sf_dir), 3_600_000), "count", "ratio", "status", keys=("symbol", "check_name"))


_N = f"p AS (SELECT *, row_number() OVER ({AT}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"
_SPLIT = f"""{_N}, q AS (SELECT *, n - round_even(n * 0.2, 0) AS fin, round_even(n * 0.2, 0) AS mid, round_even(n * 0.6, 0) AS tgt FROM p),
b AS (SELECT *, least(fin - mid, greatest(1, tgt)) AS beg FROM q), g AS (SELECT *, CASE WHEN beg - 10 >= 10 AND fin - beg - 10 >= 10 THEN 10 ELSE 0 END AS gap FROM b)"""


@register("split_plan", f"WITH {BARS}, {_SPLIT} SELECT symbol, open_time, CASE WHEN rn < beg - gap THEN 'discovery' WHEN rn < beg THEN 'gap' WHEN rn < fin - gap THEN 'validation' WHEN rn < fin THEN 'gap' ELSE 'holdout' END AS split FROM g")
def split_plan(spark, sf_dir):
    return quality.split_plan(hourly(spark, sf_dir), gap=10).select("symbol", "open_time", "split")


@register("walk_forward_mask", f"WITH {BARS}, {_N} SELECT symbol, open_time, rn >= 110 AND (rn - 110) % 40 < 25 AS oos FROM p")
def walk_forward_mask(spark, sf_dir):
    return quality.walk_forward_mask(hourly(spark, sf_dir), train=80, validation=20, test=25, purge=10, embargo=5).select("symbol", "open_time", "oos")


@register("median_interval", f"WITH {BARS}, {_STEP} SELECT symbol, round(quantile_cont(gap, 0.5), 6) + 0.0 AS median_ms FROM s WHERE gap > 0 GROUP BY 1")
def median_interval(spark, sf_dir):
    return shown(quality.median_interval(hourly(spark, sf_dir)), "median_ms", keys=("symbol",))


@register("dedup_first", "SELECT o_custkey AS symbol, CAST(epoch_ms(o_orderdate) AS BIGINT) AS open_time, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def dedup_first(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("open_time"), "o_orderkey")
    return src.first_per_time(o).select("symbol", "open_time", "o_orderkey")


# ---- as-of joins -----------------------------------------------------------
# Orders are irregular events here: an order's priority decides its instrument.

_SYMBOL = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'click' WHEN '2' THEN 'error' WHEN '3' THEN 'purchase' WHEN '4' THEN 'signup' ELSE 'view' END"
_EVENTS = f"""span AS (SELECT min(open_time) AS lo, max(open_time) AS hi FROM bars),
ev AS (SELECT {_SYMBOL} AS symbol, lo + (o_orderkey * 7919000) % (hi - lo + 7200000) - 3600000 AS calc_time, max(o_totalprice) / 99991 - 2 AS rate FROM orders, span GROUP BY 1, 2)"""


def funding_events(spark, sf_dir) -> DataFrame:
    b = hourly(spark, sf_dir).agg(F.min("open_time").alias("lo"), F.max("open_time").alias("hi")).first()
    lo, hi = b["lo"], b["hi"]
    o = table(spark, sf_dir, "orders")
    digit = F.substring("o_orderpriority", 1, 1)
    symbol = F.when(digit == "1", "click").when(digit == "2", "error").when(digit == "3", "purchase").when(digit == "4", "signup").otherwise("view")
    time = F.lit(lo) + (F.col("o_orderkey") * 7919000) % F.lit(hi - lo + 7200000) - 3600000
    return o.groupBy(symbol.alias("symbol"), time.alias("calc_time")).agg((F.max("o_totalprice") / 99991 - 2).alias("rate"))


@register("asof_backward", f"WITH {BARS}, {_EVENTS} SELECT b.symbol, b.open_time, round(coalesce(e.rate, 0), 6) + 0.0 AS rate FROM bars b ASOF LEFT JOIN ev e ON b.symbol = e.symbol AND b.open_time >= e.calc_time")
def asof_backward(spark, sf_dir):
    return shown(joins.as_of(hourly(spark, sf_dir), funding_events(spark, sf_dir), "rate", default=0.0), "rate")


@register("event_zscore_asof", f"WITH {BARS}, {_EVENTS}, zs AS (SELECT *, (rate - CASE WHEN count(rate) OVER w >= 21 THEN avg(rate) OVER w END) / nullif(stddev_samp(rate) OVER w, 0) AS zscore FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY calc_time ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) SELECT b.symbol, b.open_time, round(coalesce(e.zscore, 0), 6) + 0.0 AS zscore FROM bars b ASOF LEFT JOIN (SELECT * FROM zs WHERE zscore IS NOT NULL) e ON b.symbol = e.symbol AND b.open_time >= e.calc_time")
def event_zscore_asof(spark, sf_dir):
    e = joins.event_zscore(funding_events(spark, sf_dir), "rate")
    return shown(joins.as_of(hourly(spark, sf_dir), e, "zscore", default=0.0), "zscore")


_FLOW = """landed AS (SELECT e.symbol, min(b.open_time) AS open_time, e.calc_time, any_value(e.rate) AS rate FROM ev e JOIN bars b ON b.symbol = e.symbol AND b.open_time >= e.calc_time GROUP BY e.symbol, e.calc_time),
firsts AS (SELECT symbol, min(open_time) AS f FROM bars GROUP BY 1), flows AS (SELECT l.symbol, l.open_time, sum(l.rate) AS flow FROM landed l JOIN firsts USING (symbol) WHERE l.calc_time >= f GROUP BY 1, 2)"""


@register("asof_forward_sum", f"WITH {BARS}, {_EVENTS}, {_FLOW} SELECT b.symbol, b.open_time, round(coalesce(flow, 0), 6) + 0.0 AS flow FROM bars b LEFT JOIN flows f ON b.symbol = f.symbol AND b.open_time = f.open_time")
def asof_forward_sum(spark, sf_dir):
    return shown(joins.as_of_forward_sum(hourly(spark, sf_dir), funding_events(spark, sf_dir), "rate"), "flow")


@register("exact_join", f"WITH {BARS} SELECT b.symbol, b.open_time, round(coalesce(e.v, 0), 6) + 0.0 AS v FROM bars b LEFT JOIN (SELECT symbol, open_time AS t, sum(close) AS v FROM bars WHERE trade_count > 3 GROUP BY 1, 2) e ON b.symbol = e.symbol AND b.open_time = e.t")
def exact_join(spark, sf_dir):
    b = hourly(spark, sf_dir)
    e = b.where("trade_count > 3").select("symbol", F.col("open_time").alias("calc_time"), F.col("close").alias("v"))
    return shown(joins.exact(b, e, "v"), "v")


@register("full_outer_align", f"WITH {BARS}, a AS (SELECT symbol, open_time, high AS x FROM bars WHERE volume > 2), b AS (SELECT symbol, open_time, low AS y FROM bars WHERE close > open) SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.open_time, b.open_time) AS open_time, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM a FULL OUTER JOIN b ON a.symbol = b.symbol AND a.open_time = b.open_time")
def full_outer_align(spark, sf_dir):
    b = hourly(spark, sf_dir)
    d = joins.align({"x": b.where("volume > 2").withColumn("value", F.col("high")), "y": b.where("close > open").withColumn("value", F.col("low"))})
    return shown(d, "x", "y")


# ---- indicators -----------------------------------------------------------


def _indicator(group: str, columns: dict[str, str], ctes: str = "", source: str = "bars") -> None:
    def run(spark, sf_dir):
        return shown(indicators.features(hourly(spark, sf_dir), [group])[0], *columns)

    QUERIES[f"indicator_{group}"] = run
    ORACLES[f"indicator_{group}"] = out(columns, source, ctes)


_c1 = f"lag(close) OVER ({AT})"
_indicator("roc", {f"roc_{n}": f"100 * (close / nullif(lag(close, {n}) OVER ({AT}), 0) - 1)" for n in (5, 10, 20)})
_indicator("willr", {f"willr_{n}": f"-100 * ({full('max', 'high', n)} - close) / nullif({full('max', 'high', n)} - {full('min', 'low', n)}, 0)" for n in (14, 28)})
_indicator("sma", {f"sma_{n}": full("avg", "close", n) for n in (10, 20, 50, 100, 200)})
_indicator("price_sma_ratio", {f"price_sma_ratio_{n}": f"close / nullif({full('avg', 'close', n)}, 0) - 1" for n in (20, 50, 100)})
_indicator("bbands", {f"bb_width_{n}": f"4 * {full('stddev_samp', 'close', n)} / nullif({full('avg', 'close', n)}, 0)" for n in (20, 50)} | {f"bb_pct_{n}": f"(close - ({full('avg', 'close', n)} - 2 * {full('stddev_samp', 'close', n)})) / nullif(4 * {full('stddev_samp', 'close', n)}, 0)" for n in (20, 50)})
_indicator("hist_vol", {f"hist_vol_{n}": f"{full('stddev_samp', 'r', n)} * sqrt(105120)" for n in (10, 20, 50)}, f"x AS (SELECT *, ln(close / nullif({_c1}, 0)) AS r FROM bars)", "x")
_indicator("vol_ratio", {f"vol_ratio_{n}": f"volume / nullif({full('avg', 'volume', n)}, 0)" for n in (10, 20)})
_indicator("obv", {"obv": f"sum(s) OVER ({AT} ROWS UNBOUNDED PRECEDING)"}, f"x AS (SELECT *, coalesce(sign(close - {_c1}), 0) * volume AS s FROM bars)", "x")
_indicator("log_ret", {f"log_ret_{n}": f"ln(close / nullif(lag(close, {n}) OVER ({AT}), 0))" for n in (1, 3, 12, 48, 288)})
_indicator("close_position", {"close_position": "(close - low) / nullif(high - low, 0)"})
_indicator("hl_ratio", {"hl_ratio": "high / nullif(low, 0)"})
_indicator("gap", {"gap": f"(open - {_c1}) / nullif({_c1}, 0)"})
_indicator("intraday_range", {"intraday_range": "(high - low) / nullif(close, 0)"})
_indicator("eff_ratio", {f"eff_ratio_{n}": f"abs(close - lag(close, {n}) OVER ({AT})) / nullif({full('sum', 'd', n)}, 0)" for n in (10, 20)}, f"x AS (SELECT *, abs(close - {_c1}) AS d FROM bars)", "x")
_indicator("stoch", {f"stoch_{a}_{n}": f"{a}{n}" for n in (14, 21) for a in ("k", "d")}, ", ".join([f"x AS (SELECT *, {', '.join(f'100 * (close - {full('min', 'low', n)}) / nullif({full('max', 'high', n)} - {full('min', 'low', n)}, 0) AS r{n}' for n in (14, 21))} FROM bars)", f"y AS (SELECT *, {', '.join(f'{full('avg', f'r{n}', 3)} AS k{n}' for n in (14, 21))} FROM x)", f"w AS (SELECT *, {', '.join(f'{full('avg', f'k{n}', 3)} AS d{n}' for n in (14, 21))} FROM y)"]), "w")
_indicator("cci", {f"cci_{n}": f"CASE WHEN len(l{n}) = {n} THEN (tp - m{n}) / nullif(0.015 * list_sum(list_transform(l{n}, lambda v: abs(v - m{n}))) / {n}, 0) END" for n in (14, 20)}, f"x AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), y AS (SELECT *, {', '.join(f'{full('avg', 'tp', n)} AS m{n}, list(tp) OVER {rows(n)} AS l{n}' for n in (14, 20))} FROM x)", "y")
_indicator("mfi", {f"mfi_{n}": f"100 - 100 / (1 + {full('sum', 'u', n)} / nullif({full('sum', 'd', n)}, 0))" for n in (14, 21)}, f"x AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), y AS (SELECT *, tp - lag(tp) OVER ({AT}) AS m FROM x), w AS (SELECT *, CASE WHEN m > 0 THEN tp * volume ELSE 0 END AS u, CASE WHEN m < 0 THEN tp * volume ELSE 0 END AS d FROM y)", "w")
_indicator("cmf", {f"cmf_{n}": f"{full('sum', 'f', n)} / nullif({full('sum', 'volume', n)}, 0)" for n in (20, 50)}, "x AS (SELECT *, ((close - low) - (high - close)) / nullif(high - low, 0) * volume AS f FROM bars)", "x")
_indicator("aroon", {"aroon_up_25": "CASE WHEN len(h) = 25 THEN 100.0 * (25 - (list_position(h, list_max(h)) - 1)) / 25 END", "aroon_down_25": "CASE WHEN len(l) = 25 THEN 100.0 * (25 - (list_position(l, list_min(l)) - 1)) / 25 END"}, f"x AS (SELECT *, list(high) OVER {rows(25)} AS h, list(low) OVER {rows(25)} AS l FROM bars)", "x")
_indicator("vol_trend_corr", {"vol_trend_corr_20": ORACLES["dsl_ts_corr"].split("round(CAST(", 1)[1].rsplit(f" AS DOUBLE), {DIGITS}) + 0.0 AS value", 1)[0]})
_indicator("microstructure", {"taker_buy_pressure": "0.5", "quote_volume_z_48": z("quote_volume", 48, 12), "trade_density_z_48": z("t", 48, 12), "quote_volume_chg_12": f"quote_volume / nullif(lag(quote_volume, 12) OVER ({AT}), 0) - 1"}, "x AS (SELECT *, trade_count / nullif(quote_volume, 0) AS t FROM bars)", "x")
QUERIES["indicator_true_range"] = lambda spark, sf_dir: shown(hourly(spark, sf_dir).withColumn("true_range", indicators.true_range()), "true_range")
ORACLES["indicator_true_range"] = out({"true_range": f"greatest(high - low, abs(high - {_c1}), abs(low - {_c1}))"}, "bars")
QUERIES["forward_return"] = lambda spark, sf_dir: shown(hourly(spark, sf_dir).withColumn("fwd", indicators.forward_return(3)), "fwd")
ORACLES["forward_return"] = out({"fwd": f"lead(close, 3) OVER ({AT}) / nullif(close, 0) - 1"}, "bars")


def _chain(alpha: dict[str, str], seed: str, step: str, columns: str) -> str:
    """Recursive CTE over rows numbered rn within a symbol."""
    first = ", ".join(f"{s} AS {k}" for k, s in zip(alpha, seed.split("|")))
    nxt = ", ".join(f"{s} AS {k}" for k, s in zip(alpha, step.split("|")))
    return f"p AS (SELECT *, row_number() OVER ({AT}) AS rn, close - {_c1} AS d FROM bars), e AS (SELECT symbol, open_time, rn, {columns}{first} FROM p WHERE rn = {list(alpha.values())[0]} UNION ALL SELECT p.symbol, p.open_time, p.rn, {nxt} FROM e JOIN p ON p.symbol = e.symbol AND p.rn = e.rn + 1)"


QUERIES["indicator_ema"] = lambda spark, sf_dir: shown(indicators.features(hourly(spark, sf_dir), ["ema"])[0], "ema_12", "ema_26")
ORACLES["indicator_ema"] = f"WITH RECURSIVE {BARS}, " + _chain({"a": "1", "b": "1"}, "close|close", "a + (p.close - a) * 2 / 13.0|b + (p.close - b) * 2 / 27.0", "") + " SELECT symbol, open_time, round(a, 6) + 0.0 AS ema_12, round(b, 6) + 0.0 AS ema_26 FROM e"
for _g, _cols in {"rsi": ("rsi_7", "rsi_14", "rsi_21"), "macd": ("macd_hist_12_26_9", "macd_line_12_26"), "adx": ("adx_14",), "atr": ("atr_14", "atr_20")}.items():
    QUERIES[f"indicator_{_g}"] = lambda spark, sf_dir, g=_g, c=_cols: shown(indicators.features(hourly(spark, sf_dir), [g])[0], *c, digits=4)


# ---- signals ---------------------------------------------------------------


def _signal(name: str, run: Callable, sql: str, ctes: str = "", source: str = "bars") -> None:
    QUERIES[f"signal_{name}"] = lambda spark, sf_dir: shown(run(hourly(spark, sf_dir)), "signal")
    ORACLES[f"signal_{name}"] = out({"signal": sql}, source, ctes)


_signal("momentum", lambda b: signals.factor_signal(b, "momentum", 12), f"coalesce(tanh(m / nullif({full('stddev_samp', 'm', 48, 12)}, 0) / 2), 0)", f"x AS (SELECT *, close / nullif(lag(close, 12) OVER ({AT}), 0) - 1 AS m FROM bars)", "x")
_signal("mean_reversion", lambda b: signals.factor_signal(b, "mean_reversion", 20), f"coalesce(-tanh({z('close', 20)} / 2), 0)")
_q = lambda p: f"CASE WHEN count(v) OVER {rows(40)} >= 10 THEN quantile_cont(v, {p}) OVER {rows(40)} END"
_signal("volatility", lambda b: signals.factor_signal(b, "volatility", 10), "coalesce(tanh((v - q5) / nullif(q7 - q2, 0) / 2), 0)", f"x AS (SELECT *, close / nullif({_c1}, 0) - 1 AS r FROM bars), y AS (SELECT *, {full('stddev_samp', 'r', 10)} AS v FROM x), w AS (SELECT *, {_q(0.5)} AS q5, {_q(0.75)} AS q7, {_q(0.25)} AS q2 FROM y)", "w")
_signal("vwap", lambda b: signals.factor_signal(b, "vwap", 20), f"coalesce(-tanh(d / nullif({full('stddev_samp', 'd', 80, 20)}, 0) / 2), 0)", f"x AS (SELECT *, coalesce(close / nullif({full('sum', 'close * volume', 20)} / nullif({full('sum', 'volume', 20)}, 0), 0) - 1, 0) AS d FROM bars)", "x")
_signal("rank", lambda b: signals.transform(b, "close", how="rank", window=50), "coalesce(CASE WHEN len(l) >= 20 THEN (len(list_filter(l, lambda v: v < close)) + (len(list_filter(l, lambda v: v = close)) + 1) / 2.0) / len(l) * 2 - 1 END, 0)", f"x AS (SELECT *, list(close) OVER {rows(50)} AS l FROM bars)", "x")
_signal("controls", lambda b: signals.controls(b.withColumn("signal", F.lit(3) * (F.col("close") - F.col("open")) / F.col("high")), threshold=0.2), "CASE WHEN abs(3 * (close - open) / high) >= 0.2 THEN greatest(-1, least(1, 3 * (close - open) / high)) ELSE 0 END")
_regimed = "CASE WHEN close > open THEN 'bull' WHEN volume > 2 THEN 'bear' ELSE 'sideways' END"
_with_regime = lambda b: b.withColumn("regime", F.when(F.col("close") > F.col("open"), "bull").when(F.col("volume") > 2, "bear").otherwise("sideways")).withColumn("signal", F.tanh((F.col("close") - F.col("low")) / 50 - 1))
_base = f"x AS (SELECT *, {_regimed} AS regime, tanh((close - low) / 50 - 1) AS s FROM bars)"
_signal("regime_hard", lambda b: signals.regime_filter(_with_regime(b), ["bull"]), "CASE WHEN regime = 'bull' THEN s ELSE 0 END", _base, "x")
_signal("regime_soft", lambda b: signals.regime_filter(_with_regime(b), ["bull"], mode="soft"), "CASE WHEN regime = 'bull' THEN s ELSE s * 0.25 END", _base, "x")
_signal("regime_entry_only", lambda b: signals.regime_filter(_with_regime(b), ["bull"], mode="entry_only"), f"CASE WHEN max(CASE WHEN regime = 'bull' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, run ORDER BY open_time ROWS UNBOUNDED PRECEDING) = 1 THEN s ELSE 0 END", f"{_base}, y AS (SELECT *, CASE WHEN sign(s) = lag(sign(s)) OVER ({AT}) THEN 0 ELSE 1 END AS new FROM x), w AS (SELECT *, sum(new) OVER ({AT} ROWS UNBOUNDED PRECEDING) AS run FROM y)", "w")
_signal("regime_signs", lambda b: signals.regime_signs(_with_regime(b), {"bear": -1, "sideways": 0}), "CASE regime WHEN 'bear' THEN -s WHEN 'sideways' THEN 0 ELSE s END", _base, "x")
_signal("modulation", lambda b: signals.modulate(_with_regime(b), "momentum"), "greatest(-3, least(3, s * CASE regime WHEN 'bull' THEN 1.5 WHEN 'bear' THEN 0.3 WHEN 'sideways' THEN 1.0 ELSE 0.5 END))", _base, "x")


def two_signals(spark, sf_dir) -> DataFrame:
    b = hourly(spark, sf_dir)
    wide = b.withColumns({"a": F.tanh((F.col("close") - F.col("open")) / 50), "b": F.tanh((F.col("high") + F.col("low") - 2 * F.col("close")) / 50)})
    return signals.stack(wide, ["a", "b"])


_TWO = "sg AS (SELECT 'a' AS candidate_id, symbol, open_time, tanh((close - open) / 50) AS signal FROM bars UNION ALL SELECT 'b', symbol, open_time, tanh((high + low - 2 * close) / 50) FROM bars)"


@register("signal_composite", f"WITH {BARS}, {_TWO} SELECT symbol, open_time, round(greatest(-3, least(3, sum(CASE candidate_id WHEN 'a' THEN 0.7 ELSE -0.3 END * signal) / 1.0)), 6) + 0.0 AS signal FROM sg GROUP BY 1, 2")
def signal_composite(spark, sf_dir):
    w = spark.createDataFrame([("mix", "a", 0.7), ("mix", "b", -0.3)], "composite_id string, candidate_id string, weight double")
    return shown(signals.composite(two_signals(spark, sf_dir), w), "signal")


@register("signal_correlation", f"WITH {BARS}, {_TWO} SELECT round(abs(corr(x.signal, y.signal)), 6) + 0.0 AS corr FROM sg x JOIN sg y ON x.symbol = y.symbol AND x.open_time = y.open_time AND x.candidate_id = 'a' AND y.candidate_id = 'b'")
def signal_correlation(spark, sf_dir):
    s = two_signals(spark, sf_dir)
    c = signals.correlate(s.where("candidate_id = 'a'"), s.where("candidate_id = 'b'").withColumn("candidate_id", F.lit("a")))
    return c.select(fr.round_zero(F.col("corr"), DIGITS).alias("corr"))


# ---- simulator -------------------------------------------------------------
# Positions without buffer and exits, so that SQL can follow.

_POS = f"""{_TWO}, ex AS (SELECT *, coalesce(lag(signal) OVER (PARTITION BY candidate_id, symbol ORDER BY open_time), 0) AS position FROM sg),
m AS (SELECT b.*, e.candidate_id, e.position, lead(b.open) OVER (PARTITION BY e.candidate_id, b.symbol ORDER BY b.open_time) / nullif(b.open, 0) - 1 AS open_return,
abs(e.position - coalesce(lag(e.position) OVER (PARTITION BY e.candidate_id, b.symbol ORDER BY b.open_time), 0)) AS turnover FROM bars b JOIN ex e ON b.symbol = e.symbol AND b.open_time = e.open_time),
rt AS (SELECT *, turnover * (5 + 1 + 25 * pow(greatest(0, coalesce(10000 * turnover / nullif(quote_volume, 0), 0)), 0.5)) / 10000 AS cost FROM m),
net AS (SELECT *, 0.01 * position * coalesce(open_return, 0) - cost AS net_return FROM rt)"""
_KEYS = ("candidate_id", "symbol", "open_time")
_BY = "(PARTITION BY candidate_id, symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING)"


def simple_path(spark, sf_dir) -> DataFrame:
    p = simulate.prepare(two_signals(spark, sf_dir), hourly(spark, sf_dir), simulate.Sizing(interval="1h"))
    p = p.withColumn("position", F.col("executable"))
    r = simulate.strategy_returns(p)
    return r.withColumn("net_return", 0.01 * F.col("position") * F.coalesce("open_return", F.lit(0.0)) - F.col("cost"))


@register("strategy_returns", f"WITH {BARS}, {_POS} SELECT candidate_id, symbol, open_time, round(position, 6) + 0.0 AS position, round(turnover, 6) + 0.0 AS turnover, round(cost, 6) + 0.0 AS cost, round(net_return, 6) + 0.0 AS net_return FROM net")
def strategy_returns(spark, sf_dir):
    return shown(simple_path(spark, sf_dir), "position", "turnover", "cost", "net_return", keys=_KEYS)


@register("metrics", f"WITH {BARS}, {_POS}, eq AS (SELECT *, product(1 + net_return) OVER {_BY} AS e FROM net), dd AS (SELECT *, e / nullif(max(e) OVER {_BY}, 0) - 1 AS d FROM eq) SELECT candidate_id, symbol, count(*) AS n, round(product(1 + net_return) - 1, 6) + 0.0 AS total_return, round(stddev_samp(net_return) * sqrt(8760), 6) + 0.0 AS annualized_vol, round(avg(net_return) / stddev_samp(net_return) * sqrt(8760), 4) + 0.0 AS sharpe, round(least(min(d), 0), 6) + 0.0 AS max_drawdown, count_if(turnover > 1e-12) AS trade_count FROM dd GROUP BY 1, 2")
def metrics(spark, sf_dir):
    m = simulate.metrics(simple_path(spark, sf_dir), year=8760.0)
    rough = m.withColumn("sharpe", F.round("sharpe", 4))
    return shown(rough, "n", "total_return", "annualized_vol", "sharpe", "max_drawdown", "trade_count", keys=_KEYS[:2])


@register("cost_summary", f"WITH {BARS}, {_POS} SELECT candidate_id, symbol, round(sum(turnover), 6) + 0.0 AS turnover, round(sum(cost) / sum(turnover) * 10000, 6) + 0.0 AS actual_cost_bps, round(greatest(0, (sum(net_return) + sum(cost)) / sum(turnover) * 10000), 6) + 0.0 AS break_even_bps FROM net GROUP BY 1, 2")
def cost_summary(spark, sf_dir):
    return shown(simulate.cost_summary(simple_path(spark, sf_dir)), "turnover", "actual_cost_bps", "break_even_bps", keys=_KEYS[:2])


_ON = "h AS (SELECT *, abs(CASE WHEN abs(position) >= 0.3 THEN position ELSE 0 END) > 1e-12 AS held FROM net), i AS (SELECT *, CASE WHEN held AND NOT coalesce(lag(held) OVER (PARTITION BY candidate_id, symbol ORDER BY open_time), false) THEN 1 ELSE 0 END AS new FROM h)"


@register("holding_runs", f"WITH {BARS}, {_POS}, {_ON} SELECT candidate_id, symbol, round(coalesce(count_if(held) / nullif(sum(new), 0), 0), 6) + 0.0 AS avg_holding, CAST(sum(new) AS BIGINT) AS runs FROM i GROUP BY 1, 2")
def holding_runs(spark, sf_dir):
    p = simple_path(spark, sf_dir).withColumn("position", F.when(F.abs("position") >= 0.3, F.col("position")).otherwise(0.0))
    return shown(simulate.holding(p), "avg_holding", "runs", keys=_KEYS[:2])


@register("trade_events", f"WITH {BARS}, {_POS}, t AS (SELECT candidate_id, symbol, open_time, position, position - coalesce(lag(position) OVER (PARTITION BY candidate_id, symbol ORDER BY open_time), 0) AS change FROM net), k AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, symbol ORDER BY open_time DESC) AS n FROM t WHERE abs(change) > 1e-12) SELECT candidate_id, symbol, open_time, CASE WHEN change > 0 THEN 'buy' ELSE 'sell' END AS side, round(change, 6) + 0.0 AS change FROM k WHERE n <= 100")
def trade_events(spark, sf_dir):
    return shown(simulate.trade_events(simple_path(spark, sf_dir), last=100), "side", "change", keys=_KEYS)


@register("regime_metrics", f"WITH {BARS}, {_POS} SELECT candidate_id, symbol, {_regimed} AS regime, count(*) AS n, round(product(1 + net_return) - 1, 6) + 0.0 AS total_return, round(sum(net_return) * 10000, 4) + 0.0 AS pnl FROM net GROUP BY 1, 2, 3")
def regime_metrics(spark, sf_dir):
    p = simple_path(spark, sf_dir).join(hourly(spark, sf_dir).select("symbol", "open_time", "close", "volume"), ["symbol", "open_time"])
    p = p.withColumn("regime", F.when(F.col("close") > F.col("open"), "bull").when(F.col("volume") > 2, "bear").otherwise("sideways"))
    return shown(simulate.regime_metrics(p, "regime", year=8760.0), "n", "total_return", keys=(*_KEYS[:2], "regime")).join(simulate.regime_metrics(p, "regime", year=8760.0).select(*_KEYS[:2], "regime", fr.round_zero(F.col("pnl"), 4).alias("pnl")), [*_KEYS[:2], "regime"])


@register("window_stability", f"WITH {BARS}, {_POS}, n4 AS (SELECT *, least(floor((row_number() OVER (PARTITION BY candidate_id, symbol ORDER BY open_time) - 1) / floor(count(*) OVER (PARTITION BY candidate_id, symbol) / 4)), 3) AS w FROM net), s AS (SELECT candidate_id, symbol, w, avg(net_return) / stddev_samp(net_return) * sqrt(8760) AS sharpe FROM n4 GROUP BY 1, 2, 3) SELECT candidate_id, symbol, CAST(count(*) AS INTEGER) AS n_windows, round(avg(sharpe), 4) + 0.0 AS sharpe_mean, round(stddev_samp(sharpe), 4) + 0.0 AS sharpe_std, round(avg(CASE WHEN sharpe > 0 THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS positive_rate FROM s GROUP BY 1, 2")
def window_stability(spark, sf_dir):
    return shown(simulate.window_stability(simple_path(spark, sf_dir), year=8760.0)[1], "n_windows", "sharpe_mean", "sharpe_std", "positive_rate", keys=_KEYS[:2], digits=4)


@register("capacity", f"WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k FROM bars) SELECT symbol, round(sum(quote_volume) / greatest(1, count(*) / 24.0), 4) + 0.0 AS adv FROM r WHERE k <= 240 GROUP BY 1")
def capacity(spark, sf_dir):
    return shown(simulate.capacity(hourly(spark, sf_dir), days=10, bars_a_day=24), "adv", keys=("symbol",), digits=4)


@register("backtest_full")
def backtest_full(spark, sf_dir):
    """Hysteresis, buffer, volatility targeting and exits: state machines that SQL does not express."""
    how = simulate.Rules(entry_band=0.3, exit_band=0.1, stop_loss=-0.05, most_bars=48, tiers=((0.02, 0.5),), trailing=0.03)
    p = simulate.backtest(two_signals(spark, sf_dir), hourly(spark, sf_dir), sizing=simulate.Sizing(interval="1h"), rules=how)
    return shown(p, "position", "turnover", "net_return", keys=_KEYS)


# ---- panel -----------------------------------------------------------------

_PANEL = f"pn AS (SELECT open_time, symbol, close AS factor, lead(open, 2) OVER ({AT}) / nullif(lead(open, 1) OVER ({AT}), 0) - 1 AS fwd_ret FROM bars)"
_RW = "rw AS (SELECT *, CASE WHEN count(*) OVER t >= 2 THEN row_number() OVER (PARTITION BY open_time ORDER BY factor, symbol) - (count(*) OVER t + 1) / 2.0 END AS c FROM pn WINDOW t AS (PARTITION BY open_time)), wt AS (SELECT *, coalesce(c / nullif(sum(abs(c)) OVER (PARTITION BY open_time), 0), 0) AS weight FROM rw)"


def _panel(spark, sf_dir) -> DataFrame:
    return panel.build_panel(hourly(spark, sf_dir), "close")


@register("xs_panel", f"WITH {BARS}, {_PANEL} SELECT open_time, symbol, round(factor, 6) + 0.0 AS factor, round(fwd_ret, 6) + 0.0 AS fwd_ret FROM pn")
def xs_panel(spark, sf_dir):
    return shown(_panel(spark, sf_dir), "factor", "fwd_ret", keys=("open_time", "symbol"))


@register("xs_universe_size", f"WITH {BARS} SELECT open_time, count(*) AS members FROM bars GROUP BY 1")
def xs_universe_size(spark, sf_dir):
    return panel.universe_size(_panel(spark, sf_dir))


@register("xs_zscore", f"WITH {BARS}, {_PANEL} SELECT open_time, symbol, round(coalesce((factor - avg(factor) OVER w) / nullif(stddev_pop(factor) OVER w, 0), 0), 6) + 0.0 AS z FROM pn WINDOW w AS (PARTITION BY open_time)")
def xs_zscore(spark, sf_dir):
    return shown(panel.zscore(_panel(spark, sf_dir)), "z", keys=("open_time", "symbol"))


@register("xs_rank_weights", f"WITH {BARS}, {_PANEL}, {_RW} SELECT open_time, symbol, round(weight, 6) + 0.0 AS weight FROM wt")
def xs_rank_weights(spark, sf_dir):
    return shown(panel.rank_weights(_panel(spark, sf_dir)), "weight", keys=("open_time", "symbol"))


@register("xs_quantile_weights", f"WITH {BARS}, {_PANEL}, q AS (SELECT *, row_number() OVER (PARTITION BY open_time ORDER BY factor, symbol) AS lo, row_number() OVER (PARTITION BY open_time ORDER BY factor DESC, symbol DESC) AS hi, count(*) OVER (PARTITION BY open_time) AS n FROM pn), k AS (SELECT *, greatest(1, floor(n * 0.4)) AS k FROM q) SELECT open_time, symbol, round(CASE WHEN n < 2 THEN 0 WHEN hi <= k THEN 0.5 / k WHEN lo <= k THEN -0.5 / k ELSE 0 END, 6) + 0.0 AS weight FROM k")
def xs_quantile_weights(spark, sf_dir):
    return shown(panel.quantile_weights(_panel(spark, sf_dir), 0.4), "weight", keys=("open_time", "symbol"))


@register("xs_long_short", f"WITH {BARS}, {_PANEL}, {_RW}, mv AS (SELECT *, abs(weight - coalesce(lag(weight) OVER (PARTITION BY symbol ORDER BY open_time), 0)) AS mv FROM wt) SELECT open_time, round(sum(weight * coalesce(fwd_ret, 0)), 6) + 0.0 AS gross, round(sum(mv), 6) + 0.0 AS turnover, round(sum(weight * coalesce(fwd_ret, 0)) - sum(mv) * 6 / 10000, 6) + 0.0 AS net_return FROM mv GROUP BY 1")
def xs_long_short(spark, sf_dir):
    return shown(panel.long_short(panel.rank_weights(_panel(spark, sf_dir))), "gross", "turnover", "net_return", keys=("open_time",))


@register("xs_ic", f"WITH {BARS}, {_PANEL}, k AS (SELECT open_time, rank() OVER (PARTITION BY open_time ORDER BY factor) + (count(*) OVER (PARTITION BY open_time, factor) - 1) / 2.0 AS x, rank() OVER (PARTITION BY open_time ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY open_time, fwd_ret) - 1) / 2.0 AS y FROM pn WHERE fwd_ret IS NOT NULL) SELECT open_time, count(*) AS n, round(CASE WHEN count(*) >= 3 AND stddev_pop(x) * stddev_pop(y) > 1e-28 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 6) + 0.0 AS ic FROM k GROUP BY 1")
def xs_ic(spark, sf_dir):
    return shown(panel.ic(_panel(spark, sf_dir)), "n", "ic", keys=("open_time",))


@register("xs_hold", f"WITH {BARS}, {_PANEL}, {_RW}, nb AS (SELECT *, dense_rank() OVER (ORDER BY open_time) - 1 AS t FROM wt), hb AS (SELECT *, floor(t / 6) AS blk FROM nb) SELECT open_time, symbol, round(coalesce(max(CASE WHEN t % 6 = 0 THEN weight END) OVER (PARTITION BY symbol, blk ORDER BY open_time ROWS UNBOUNDED PRECEDING), 0), 6) + 0.0 AS weight FROM hb")
def xs_hold(spark, sf_dir):
    return shown(panel.hold(panel.rank_weights(_panel(spark, sf_dir)), 6), "weight", keys=("open_time", "symbol"))


# ---- inference -------------------------------------------------------------

_ONE = ("candidate_id", "symbol")


@register("sharpe", f"WITH {BARS}, {_POS} SELECT candidate_id, symbol, round(avg(net_return) / stddev_samp(net_return) * sqrt(8760), 5) + 0.0 AS sharpe FROM net GROUP BY 1, 2")
def sharpe(spark, sf_dir):
    return simple_path(spark, sf_dir).groupBy(*_ONE).agg(fr.round_zero(inference.sharpe(F.col("net_return"), 8760.0), 5).alias("sharpe"))


@register("moments", f"WITH {BARS}, {_POS}, c AS (SELECT *, net_return - avg(net_return) OVER (PARTITION BY candidate_id, symbol) AS d, stddev_samp(net_return) OVER (PARTITION BY candidate_id, symbol) AS s FROM net) SELECT candidate_id, symbol, count(*) AS n, round(avg(pow(d / s, 3)), 5) + 0.0 AS skew, round(avg(pow(d / s, 4)), 5) + 0.0 AS kurtosis FROM c GROUP BY 1, 2")
def moments(spark, sf_dir):
    return shown(simple_path(spark, sf_dir).groupBy(*_ONE).agg(*inference.moments(F.col("net_return"))), "n", "skew", "kurtosis", keys=_ONE, digits=5)


@register("autocorrelation", f"WITH {BARS}, {_POS}, l AS (SELECT *, lag(net_return) OVER (PARTITION BY candidate_id, symbol ORDER BY open_time) AS b FROM net) SELECT candidate_id, symbol, round(corr(net_return, b), 6) + 0.0 AS autocorr1 FROM l GROUP BY 1, 2")
def autocorrelation(spark, sf_dir):
    return shown(inference.autocorrelation(simple_path(spark, sf_dir), "net_return", keys=_ONE), "autocorr1", keys=_ONE)


@register("newey_west", f"WITH {BARS}, {_POS}, c AS (SELECT candidate_id, symbol, open_time, net_return, net_return - avg(net_return) OVER (PARTITION BY candidate_id, symbol) AS d FROM net), k AS (SELECT *, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2, lag(d, 3) OVER w AS d3 FROM c WINDOW w AS (PARTITION BY candidate_id, symbol ORDER BY open_time)) SELECT candidate_id, symbol, count(*) AS n, round(avg(net_return) / sqrt((sum(d * d) + 2 * (0.75 * sum(d * d1) + 0.5 * sum(d * d2) + 0.25 * sum(d * d3))) / count(*) / count(*)), 5) + 0.0 AS tstat FROM k GROUP BY 1, 2")
def newey_west(spark, sf_dir):
    return shown(inference.newey_west(simple_path(spark, sf_dir), "net_return", lag=3, keys=_ONE), "n", "tstat", keys=_ONE, digits=5)


_P = "p AS (SELECT o_orderpriority AS family, o_orderkey AS id, ((o_orderkey * 7919) % 100003) / 100003.0 AS p FROM orders)"


@register("benjamini_hochberg", f"WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS k, count(*) OVER (PARTITION BY family) AS n FROM p) SELECT family, id, round(least(1, min(p * n / k) OVER (PARTITION BY family ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) + 0.0 AS q FROM r")
def benjamini_hochberg(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("family"), F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") * 7919) % 100003 / 100003.0).alias("p"))
    return shown(inference.benjamini_hochberg(p, family=("family",)), "q", keys=("family", "id"))


@register("rolling_ic", f"WITH {BARS}, f AS (SELECT *, close - open AS x, lead(close) OVER ({AT}) / nullif(close, 0) - 1 AS y, row_number() OVER ({AT}) AS rn FROM bars), g AS (SELECT symbol, open_time, rn, count(y) OVER w AS n, covar_pop(x, y) OVER w AS c, stddev_pop(CASE WHEN y IS NOT NULL THEN x END) OVER w AS sx, stddev_pop(y) OVER w AS sy FROM f WINDOW w AS ({AT} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) SELECT symbol, open_time, round(CASE WHEN rn >= 10 AND n >= 2 THEN coalesce(c / nullif(sx * sy, 0), 0) ELSE 0 END, 6) + 0.0 AS ic FROM g")
def rolling_ic(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumns({"x": F.col("close") - F.col("open"), "y": indicators.forward_return(1)})
    return shown(inference.rolling_ic(b, "x", "y", window=50, keys=("symbol",)), "ic")


@register("rank_ic", f"WITH {BARS}, f AS (SELECT symbol, close - open AS x, lead(close) OVER ({AT}) / nullif(close, 0) - 1 AS y FROM bars), k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2.0 AS b FROM f WHERE y IS NOT NULL) SELECT symbol, round(corr(a, b), 6) + 0.0 AS rank_ic FROM k GROUP BY 1")
def rank_ic(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumns({"x": F.col("close") - F.col("open"), "y": indicators.forward_return(1)})
    return shown(inference.rank_ic(b, "x", "y", keys=("symbol",)), "rank_ic", keys=("symbol",))


@register("ic_by_horizon", f"WITH {BARS}, h AS (SELECT * FROM (VALUES (1), (3), (6)) t(horizon)), f AS (SELECT symbol, open_time, close - open AS x, " + ", ".join(f"lead(open, {k + 1}) OVER ({AT}) / nullif(lead(open, 1) OVER ({AT}), 0) - 1 AS r{k}" for k in (1, 3, 6)) + " FROM bars) SELECT symbol, horizon, count(CASE horizon WHEN 1 THEN r1 WHEN 3 THEN r3 ELSE r6 END) AS n, round(corr(x, CASE horizon WHEN 1 THEN r1 WHEN 3 THEN r3 ELSE r6 END), 6) + 0.0 AS ic FROM f, h GROUP BY 1, 2")
def ic_by_horizon(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumn("x", F.col("close") - F.col("open"))
    return shown(inference.ic_by_horizon(b, "x", (1, 3, 6), keys=("symbol",)), "n", "ic", keys=("symbol", "horizon"))


@register("conditional_ic", f"WITH {BARS}, f AS (SELECT symbol, {_regimed} AS regime, close - low AS x, lead(close) OVER ({AT}) / nullif(close, 0) - 1 AS y FROM bars) SELECT symbol, regime, count(*) AS n, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) + 0.0 AS ic FROM f WHERE y IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20")
def conditional_ic(spark, sf_dir):
    b = _with_regime(hourly(spark, sf_dir)).withColumns({"x": F.col("close") - F.col("low"), "y": indicators.forward_return(1)})
    return shown(inference.conditional_ic(b, "x", "y", "regime", least=20, keys=("symbol",)), "n", "ic", keys=("symbol", "regime"))


@register("quantile_spread", f"WITH {BARS}, f AS (SELECT symbol, open_time, close - open AS x, lead(close) OVER ({AT}) / nullif(close, 0) - 1 AS y FROM bars), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY x, open_time) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM f WHERE y IS NOT NULL), b AS (SELECT *, greatest(1, ceil((r - 1) * 5 / (n - 1))) AS b FROM k) SELECT symbol, round((avg(CASE WHEN b = 5 THEN y END) - avg(CASE WHEN b = 1 THEN y END)) * 10000, 4) + 0.0 AS spread_bps FROM b GROUP BY 1")
def quantile_spread(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumns({"x": F.col("close") - F.col("open"), "y": indicators.forward_return(1)})
    return shown(inference.quantile_spread(b, "x", "y", keys=("symbol",)), "spread_bps", keys=("symbol",), digits=4)


@register("numeric_summary", "WITH s AS (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS a, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderpriority, n AS count, round(a[1], 6) + 0.0 AS min, round(a[CAST(floor((n - 1) * 0.25) AS BIGINT) + 1], 6) + 0.0 AS p25, round(a[CAST(floor((n - 1) * 0.5) AS BIGINT) + 1], 6) + 0.0 AS median, round(a[CAST(floor((n - 1) * 0.75) AS BIGINT) + 1], 6) + 0.0 AS p75, round(a[n], 6) + 0.0 AS max FROM s")
def numeric_summary(spark, sf_dir):
    return shown(inference.summary(table(spark, sf_dir, "orders"), "o_totalprice", ("o_orderpriority",)), "count", "min", "p25", "median", "p75", "max", keys=("o_orderpriority",))


@register("wilson_interval", "WITH c AS (SELECT o_orderpriority, count_if(o_totalprice > 100000) AS k, count(*) AS n FROM orders GROUP BY 1), d AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM c) SELECT o_orderpriority, round(((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) + 0.0 AS low, round(((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) + 0.0 AS high FROM d")
def wilson_interval(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_totalprice") > 100000).alias("k"), F.count(F.lit(1)).alias("n"))
    return shown(c.select("o_orderpriority", *inference.wilson(F.col("k"), F.col("n"))), "low", "high", keys=("o_orderpriority",))


@register("pbo_cscv")
def pbo_cscv(spark, sf_dir):
    r = simple_path(spark, sf_dir).withColumn("candidate_id", F.concat_ws("/", "candidate_id", "symbol"))
    return shown(inference.pbo(r), "pbo", keys=("candidate_id",))


@register("romano_wolf")
def romano_wolf(spark, sf_dir):
    r = simple_path(spark, sf_dir).select("symbol", "candidate_id", "open_time", "net_return")
    return shown(inference.romano_wolf(r, family="symbol", name="candidate_id", resamples=200), "fwer_p", keys=("symbol", "candidate_id"))


@register("bootstrap_sharpe")
def bootstrap_sharpe(spark, sf_dir):
    return shown(inference.bootstrap_sharpe(simple_path(spark, sf_dir), "net_return", year=8760.0, resamples=200, block=24, keys=_ONE), "ci_low", "ci_high", keys=_ONE)


@register("permutation_test")
def permutation_test(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumns({"x": F.col("close") - F.col("open"), "y": indicators.forward_return(1)})
    return shown(inference.permutation_p(b, "x", "y", keys=("symbol",)), "p", keys=("symbol",))


@register("rolling_rank_ic")
def rolling_rank_ic(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumns({"x": F.col("close") - F.col("open"), "y": indicators.forward_return(1)}).where("y is not null")
    return shown(inference.rolling_rank_ic(b, "x", "y", window=48, keys=("symbol",)), "rank_ic")


@register("regime_rolling")
def regime_rolling(spark, sf_dir):
    return regime.rolling_labels(hourly(spark, sf_dir), window=48).select("symbol", "open_time", "regime")


@register("regime_model")
def regime_model(spark, sf_dir):
    return regime.model_regimes(hourly(spark, sf_dir), states=3).select("symbol", "open_time", "regime")


# ---- rules -----------------------------------------------------------------
# Made-up result rows from orders; every field is a plain function of the key.

_FIELDS = {
    "deflated_sharpe_prob": "(k % 10) / 9.0", "pbo": "(k % 7) / 8.0", "fdr_p": "(k % 5) / 40.0", "ic_tstat": "(k % 9) / 2.0", "rankic_tstat": "(k % 8) / 2.0", "ci_low": "(k % 6) / 5.0 - 0.3",
    "oos_trades": "k % 300", "break_even_bps": "(k % 40) / 1.0", "actual_cost_bps": "6.0", "prior_posterior_ratio": "0.5 + (k % 12) / 2.0", "capacity_usd": "k % 50000 + 5000.0",
    "autocorr1": "(k % 30) / 100.0", "degraded_ratio": "(k % 25) / 100.0", "deflated_sharpe": "(k % 11) / 3.0", "max_abs_ic": "(k % 4) / 100.0", "max_abs_rankic": "(k % 3) / 100.0",
    "max_abs_spread": "(k % 5) / 2.0", "net_sharpe": "(k % 13) / 4.0 - 1", "gross_sharpe": "(k % 13) / 3.0", "decay_quality": "(k % 10) / 10.0", "turnover_adjusted_return": "(k % 3) - 1.0",
}
_RESULTS = "res AS (SELECT o_orderkey AS experiment_id, " + ", ".join(f"{e} AS {n}" for n, e in _FIELDS.items()) + " FROM (SELECT *, o_orderkey AS k FROM orders))"


def results(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("experiment_id"), F.col("o_orderkey").alias("k"))
    d = o.select("experiment_id", *[F.expr(e.replace(".0", ".0D").replace("0.5 ", "0.5D ").replace("- 0.3", "- 0.3D")).cast("long" if n == "oos_trades" else "double").alias(n) for n, e in _FIELDS.items()])
    return d.withColumns({"leakage_passed": F.lit(True), "schedulable": F.lit(True)})


_GATES = {
    "G1": ("deflated_sharpe_prob >= 0.95", "deflated_sharpe_prob"), "G3": ("fdr_p <= 0.05", "fdr_p"), "G4": ("ic_tstat > 2", "ic_tstat"), "G4R": ("rankic_tstat > 2", "rankic_tstat"), "G5": ("ci_low > 0", "ci_low"),
    "G2": ("pbo < 0.40", "pbo"), "G7": ("oos_trades >= 100", "oos_trades"), "G8": ("break_even_bps > 2 * actual_cost_bps", "break_even_bps"), "G9": ("prior_posterior_ratio < 5", "prior_posterior_ratio"),
    "G10": ("capacity_usd >= 10000", "capacity_usd"), "G11": ("true", "NULL"), "G6": ("true", "0"), "G13": ("abs(autocorr1) <= 0.10", "abs(autocorr1)"), "G14": (None, "degraded_ratio"), "G15": ("true", "NULL"),
}


def _gate_sql(rule: str) -> str:
    ok, value = _GATES[rule]
    bad = "fail" if rule in rules.BLOCKING else "warn"
    status = "CASE WHEN degraded_ratio <= 0.10 THEN 'pass' WHEN degraded_ratio <= 0.20 THEN 'warn' ELSE 'fail' END" if ok is None else f"CASE WHEN {ok} THEN 'pass' ELSE '{bad}' END"
    return f"SELECT experiment_id, '{rule}' AS rule_id, {status} AS status, CAST({value} AS DOUBLE) AS value FROM res"


_ITEMS = "items AS (" + " UNION ALL ".join(map(_gate_sql, _GATES)) + ")"
_TIERS = f"""{_RESULTS}, {_ITEMS}, fl AS (SELECT experiment_id, count_if(status = 'fail') AS f FROM items GROUP BY 1),
dm AS (SELECT res.*, f, (max_abs_ic >= 0.01)::INT + (max_abs_rankic >= 0.01)::INT + (turnover_adjusted_return > 0)::INT + (decay_quality >= 0.25)::INT + (max_abs_spread >= 1)::INT AS dimensions FROM res JOIN fl USING (experiment_id)),
lv AS (SELECT *, CASE WHEN dimensions >= 4 AND max_abs_ic >= 0.01 THEN 'strong' WHEN dimensions >= 2 AND (max_abs_ic >= 0.01 OR max_abs_rankic >= 0.01 OR max_abs_spread >= 1) THEN 'moderate' ELSE 'weak' END AS evidence_level FROM dm),
ti AS (SELECT *, CASE WHEN f > 0 OR evidence_level = 'weak' THEN 'fail' WHEN evidence_level = 'strong' THEN 'full_pass' ELSE 'conditional_pass' END AS risk_tier FROM lv),
al AS (SELECT *, CASE risk_tier WHEN 'fail' THEN 0.0 WHEN 'full_pass' THEN 1.0 ELSE 0.25 END AS allocation FROM ti)"""


@register("gatecheck", f"WITH {_RESULTS}, {_ITEMS} SELECT experiment_id, rule_id, status, round(value, 6) + 0.0 AS value FROM items")
def gatecheck(spark, sf_dir):
    return shown(rules.gates(results(spark, sf_dir)), "status", "value", keys=("experiment_id", "rule_id"))


@register("gate_diagnostics", f"WITH {_RESULTS}, {_ITEMS} SELECT rule_id, count_if(status = 'fail') AS fails, count_if(status = 'warn') AS warns, count(*) AS rows FROM items GROUP BY 1")
def gate_diagnostics(spark, sf_dir):
    return rules.diagnostics(rules.gates(results(spark, sf_dir)))


@register("risk_tier", f"WITH {_TIERS} SELECT experiment_id, dimensions, evidence_level, risk_tier, CAST(allocation AS DOUBLE) AS allocation FROM al")
def risk_tier(spark, sf_dir):
    return rules.stratify(results(spark, sf_dir)).select("experiment_id", "dimensions", "evidence_level", "risk_tier", "allocation")


_SCORE = "round(25 * tanh(greatest(0, deflated_sharpe) / 2) + 20 * greatest(0, least(1, 1 - pbo)) + 15 * tanh(greatest(0, greatest(ic_tstat, rankic_tstat)) / 4) + 10 * greatest(0, least(1, 1 - fdr_p / 0.05)) + 10 * sqrt(greatest(0, least(1, oos_trades / 100))) + 7 * greatest(0, least(1, 1 - abs(ln(prior_posterior_ratio)) / ln(5))) + 5 * greatest(0, least(1, 1 - abs(autocorr1) / 0.2)), 4)"


@register("hard_score", f"WITH {_TIERS} SELECT experiment_id, CAST(round(CAST(CASE WHEN risk_tier <> 'fail' THEN {_SCORE} ELSE 0 END AS DECIMAL(18, 4)) * CAST(allocation AS DECIMAL(18, 2)), 4) AS DOUBLE) AS score FROM al")
def hard_score(spark, sf_dir):
    return shown(rules.hard_score(rules.stratify(results(spark, sf_dir))), "score", keys=("experiment_id",), digits=4)


_UNDER = "(fdr_p > 0.05 AND oos_trades < 100 AND deflated_sharpe_prob >= 0.5 AND net_sharpe > 0 AND break_even_bps - 2 * actual_cost_bps > 0)"
_RG = f"rg AS (SELECT *, CASE WHEN risk_tier <> 'fail' THEN 10 ELSE 0 END + CASE WHEN risk_tier = 'conditional_pass' THEN 5 ELSE 0 END + CASE WHEN max_abs_ic >= 0.01 THEN 1 ELSE 0 END + CASE WHEN max_abs_rankic >= 0.01 THEN 1 ELSE 0 END + CASE WHEN max_abs_spread >= 1 THEN 1 ELSE 0 END + CASE WHEN gross_sharpe >= 0.5 THEN 1 ELSE 0 END + CASE WHEN net_sharpe > 0 THEN 0.5 ELSE 0 END + CASE WHEN break_even_bps - 2 * actual_cost_bps > 0 THEN 0.5 ELSE 0 END + CASE WHEN {_UNDER} THEN 1 ELSE 0 END AS research_score FROM al)"


@register("research_gate", f"WITH {_TIERS}, {_RG} SELECT experiment_id, CAST(research_score AS DOUBLE) AS research_score, CASE WHEN risk_tier <> 'fail' THEN 'production_passed' WHEN research_score >= 1.5 THEN 'research_survivor' ELSE 'rejected' END AS research_status FROM rg")
def research_gate(spark, sf_dir):
    return rules.research_gate(rules.stratify(results(spark, sf_dir))).select("experiment_id", "research_score", "research_status")


_NM = f"""nm AS (SELECT *, CASE WHEN {_UNDER} THEN 'statistically_underpowered_survivor' WHEN gross_sharpe >= 0.5 AND (net_sharpe <= 0 OR gross_sharpe - net_sharpe >= 0.75 OR break_even_bps - 2 * actual_cost_bps < 0) THEN 'cost_destroyed_edge'
WHEN -net_sharpe >= 0.5 AND 0 >= 0.4 THEN 'long_short_asymmetry' WHEN oos_trades < 100 THEN 'insufficient_trades' WHEN pbo >= 0.40 OR ci_low <= 0 THEN 'overfit_or_unstable' WHEN research_score >= 1.5 THEN 'weak_but_stable_ic' ELSE 'no_evidence' END AS why FROM rg)"""


@register("near_miss", f"WITH {_TIERS}, {_RG}, {_NM} SELECT experiment_id, CASE WHEN risk_tier <> 'fail' THEN 'production_passed' ELSE why END AS primary_reason, risk_tier = 'fail' AND why <> 'no_evidence' AS actionable FROM nm")
def near_miss(spark, sf_dir):
    return rules.near_miss(rules.research_gate(rules.stratify(results(spark, sf_dir)))).select("experiment_id", "primary_reason", "actionable")


# ---- search, sets, ledger --------------------------------------------------


@register("param_grid", "WITH p AS (SELECT DISTINCT o_orderpriority AS parent_id FROM orders), g AS (SELECT parent_id, a.s AS smooth_span, b.t AS signal_threshold, c.u AS position_buffer FROM p, (VALUES (12), (24), (48)) a(s), (VALUES (0.1), (0.2)) b(t), (VALUES (0.05), (0.15), (0.25)) c(u)), k AS (SELECT *, log2(smooth_span) + 4 * signal_threshold + 2 * position_buffer AS score FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY score DESC, smooth_span, signal_threshold, position_buffer) AS n FROM k) SELECT parent_id, smooth_span, CAST(signal_threshold AS DOUBLE) AS signal_threshold, CAST(position_buffer AS DOUBLE) AS position_buffer, round(score, 6) + 0.0 AS score FROM r WHERE n <= 8")
def param_grid(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("parent_id")).distinct()
    axes = {"smooth_span": [12, 24, 48], "signal_threshold": [0.1, 0.2], "position_buffer": [0.05, 0.15, 0.25]}
    score = F.log2(F.col("smooth_span").cast("double")) + 4 * F.col("signal_threshold") + 2 * F.col("position_buffer")
    return shown(search.grid(p, axes, per_parent=8, score=score), "smooth_span", "signal_threshold", "position_buffer", "score", keys=("parent_id",))


@register("top_k_per_parent", "SELECT parent_id, candidate_id, round(score, 6) + 0.0 AS score FROM (SELECT o_custkey AS parent_id, o_orderkey AS candidate_id, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def top_k_per_parent(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent_id"), F.col("o_orderkey").alias("candidate_id"), F.col("o_totalprice").alias("score"))
    return shown(search.top_per_parent(o, 3), "score", keys=("parent_id", "candidate_id"))


_REPAIRS = "rp AS (SELECT o_orderkey AS candidate_id, o_custkey AS parent_id, o_totalprice AS score, 'f' || (o_orderkey % 3) AS family, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'f' || (o_orderkey % 6 % 3) END AS parent_family, o_orderkey % 9 AS complexity, (o_orderkey % 7) / 8.0 AS pbo, (o_orderkey % 10) / 10.0 AS parent_corr, o_orderkey % 4 = 0 AS is_tuning FROM orders)"


@register("merge_pool", f"WITH {_REPAIRS}, w AS (SELECT *, CASE WHEN parent_family IS NULL THEN 'parent_missing_validation' WHEN family <> parent_family THEN 'cross_family_mutation' WHEN complexity > 6 THEN 'complexity_cap' WHEN pbo > 0.5 THEN 'high_validation_pbo' WHEN NOT is_tuning AND parent_corr >= 0.8 THEN 'low_incremental_orthogonality' END AS why FROM rp), n AS (SELECT *, row_number() OVER (PARTITION BY parent_id, is_tuning, why IS NULL ORDER BY score DESC, candidate_id) AS n FROM w) SELECT candidate_id, coalesce(why, CASE WHEN is_tuning AND n > 3 THEN 'local_tuning_parent_ratio_cap' WHEN NOT is_tuning AND n > 4 THEN 'repair_parent_ratio_cap' END) AS reason FROM n")
def merge_pool(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        k.alias("candidate_id"), F.col("o_custkey").alias("parent_id"), F.col("o_totalprice").alias("score"), F.concat(F.lit("f"), k % 3).alias("family"), F.when(k % 11 != 0, F.concat(F.lit("f"), k % 6 % 3)).alias("parent_family"),
        (k % 9).alias("complexity"), (k % 7 / 8.0).alias("pbo"), (k % 10 / 10.0).alias("parent_corr"), (k % 4 == 0).alias("is_tuning"),
    )
    return search.merge_pool(o).select("candidate_id", "reason")


@register("fingerprint_novelty", "SELECT DISTINCT o_custkey AS fingerprint FROM orders WHERE o_custkey NOT IN (SELECT l_suppkey FROM lineitem) AND o_custkey NOT IN (SELECT s_suppkey + 50 FROM supplier)")
def fingerprint_novelty(spark, sf_dir):
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("fingerprint")).distinct()
    return joins.novel(new, table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("fingerprint")), table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 50).alias("fingerprint")))


@register("evidence_weights", "WITH d AS (SELECT o_custkey AS composite_id, o_orderkey AS candidate_id, 1 / greatest(0.02, least(1.0, o_totalprice / 1000000)) AS raw FROM orders) SELECT composite_id, candidate_id, round(raw / sum(raw) OVER (PARTITION BY composite_id), 6) + 0.0 AS weight FROM d")
def evidence_weights(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("composite_id"), F.col("o_orderkey").alias("candidate_id"), (F.col("o_totalprice") / 1000000).alias("turnover"), *[F.lit(None).cast("double").alias(c) for c in ("ic_tstat", "rankic_tstat", "research_score", "gross_sharpe")])
    return shown(search.evidence_weights(o, "inverse_turnover"), "weight", keys=("composite_id", "candidate_id"))


@register("diverse_subset", "WITH r AS (SELECT o_orderpriority AS family, o_orderkey AS candidate_id, o_totalprice AS score, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) SELECT family, candidate_id, round(score, 6) + 0.0 AS score FROM r ORDER BY n, score DESC, candidate_id LIMIT 12")
def diverse_subset(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("family"), F.col("o_orderkey").alias("candidate_id"), F.col("o_totalprice").alias("score"))
    return shown(search.diverse(o, 12), "score", keys=("family", "candidate_id"))


_TRIALS = "tr AS (SELECT o_orderkey AS trial_id, lower(o_orderpriority) AS family, o_custkey AS lineage_id, o_orderdate AS evaluated_at FROM orders)"


@register("trial_counts", f"WITH {_TRIALS}, g AS (SELECT count(DISTINCT CASE WHEN evaluated_at >= (SELECT max(evaluated_at) FROM tr) - INTERVAL 90 DAY THEN lineage_id END) AS rolling, count(DISTINCT lineage_id) AS global FROM tr) SELECT family, count(DISTINCT lineage_id) AS family_count, any_value(rolling) AS rolling, any_value(global) AS global, greatest(count(DISTINCT lineage_id), any_value(rolling)) AS effective FROM tr, g GROUP BY 1")
def trial_counts(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial_id"), F.lower("o_orderpriority").alias("family"), F.col("o_custkey").alias("lineage_id"), F.col("o_orderdate").alias("evaluated_at"))
    now = t.agg(F.max("evaluated_at")).first()[0]
    return ledger.trial_counts(t, F.lit(now))


@register("latest_artifact", "SELECT key, payload FROM (SELECT o_custkey AS key, o_orderkey AS payload, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_artifact(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("payload"), F.col("o_orderdate").alias("updated_at"))
    return ledger.latest(o, "key").select("key", "payload")


@register("event_sequence", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def event_sequence(spark, sf_dir):
    return ledger.event_sequence(table(spark, sf_dir, "events"), "user_id").select("event_id", F.col("seq").cast("long").alias("seq"))


@register("operator_rates", "WITH t AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'SEED' WHEN 1 THEN 'CROSSOVER' WHEN 2 THEN 'MUTATION_AT_DSL' ELSE 'SEED' END AS operator, o_orderstatus = 'F' AS won FROM orders) SELECT operator, count(*) AS n, round(avg(CASE WHEN won THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS promoted_rate FROM t GROUP BY 1")
def operator_rates(spark, sf_dir):
    m = F.col("o_orderkey") % 4
    c = table(spark, sf_dir, "orders").select(
        F.when(m == 1, "composite").when(m == 2, "repair").otherwise("original").alias("candidate_type"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("generated_by"), F.lit(None).cast("string").alias("parent_id"),
        F.lit(False).alias("lab_direction"), F.when(F.col("o_orderstatus") == "F", "promoted").otherwise("rejected").alias("outcome"), F.array().cast("array<string>").alias("parent_ids"),
    )
    return shown(ledger.success_report(ledger.operator_class(c)), "n", "promoted_rate", keys=("operator",))


@register("mining_boundary", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 250 >= 150 THEN 'max trials reached' WHEN (o_orderkey % 60) / 100.0 < 0.40 THEN 'OOS/IS IC ratio too low' WHEN (o_orderkey % 8) / 2.0 < 2.0 THEN 'break-even multiple too low' WHEN o_orderkey % 3 = 0 THEN 'short side is blocked' ELSE 'all boundaries satisfied' END AS reason FROM orders")
def mining_boundary(spark, sf_dir):
    k = F.col("o_orderkey")
    f = table(spark, sf_dir, "orders").select(k.alias("id"), F.lit("funding_basis").alias("family"), (k % 250).alias("trials"), (k % 60 / 100.0).alias("oos_ic_ratio"), (k % 8 / 2.0).alias("break_even_multiple"), (k % 3 == 0).alias("uses_short"))
    return search.within_boundary(f).select("id", "reason")


@register("set_operations", "SELECT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_operations(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return a.intersect(table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")))




@register("method_registry")
def method_registry(spark, sf_dir):
    return methods.registry(spark)


@register("evidence_report")
def evidence_report(spark, sf_dir):
    p = simulate.backtest(two_signals(spark, sf_dir), hourly(spark, sf_dir), sizing=simulate.Sizing(interval="1h"))
    columns = ("max_abs_ic", "max_abs_rankic", "max_abs_spread", "best_horizon", "decay_quality", "net_sharpe", "gross_sharpe")
    return shown(evidence.report(p, horizons=(1, 6), year=8760.0), *columns, keys=_ONE)


from sigmill import more_queries  # noqa: E402, F401  (registers its own)
