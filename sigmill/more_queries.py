"""More registered queries: recursive indicators, signals with funding, search, rules and metadata.

Imported at the end of ``sigmill.queries``, whose helpers it uses.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmill.operators import inference, joins, ledger, panel, proposals, quality, rules, search, signals, simulate
from sigmill.plans import methods
from sigmill.queries import _EVENTS, _KEYS, _PANEL, _POS, _RESULTS, _SPLIT, _TWO, AT, BARS, ORACLES, QUERIES, _panel, _regimed, _with_regime, full, funding_events, hourly, out, register, results, shown, simple_path, table, two_signals, z
from sigmill.sources import bars as src

# ---- recursive indicators ------------------------------------------------------
# An exponential average of x is a state e with e + (x - e) * alpha in each next row.

_P = f"p AS (SELECT *, row_number() OVER ({AT}) AS rn, close - lag(close) OVER ({AT}) AS d, greatest(high - low, abs(high - lag(close) OVER ({AT})), abs(low - lag(close) OVER ({AT}))) AS tr, high - lag(high) OVER ({AT}) AS up, lag(low) OVER ({AT}) - low AS dn FROM bars)"


def _num(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _alpha(a: float) -> float:
    """The weight as it is after it has been turned to a centre of mass and back; ties of rounding hang on the last bit."""
    return 1 / (1 + (1 - a) / a)


def _ewm(states: dict[str, tuple[str, float]], first: int = 1, more: str = "", name: str = "e") -> str:
    """Recursive CTE with an exponential average (of an expression over p, with an alpha) for each state."""
    seed = ", ".join(f"CAST({x} AS DOUBLE) AS {k}" for k, (x, _) in states.items())
    step = ", ".join(f"({_num(1 - a)} * {name}.{k} + {_num(a)} * ({x})) / {_num((1 - a) + a)} AS {k}" for k, (x, a) in states.items())
    return f"{name} AS (SELECT p.symbol, p.open_time, p.rn, {seed} FROM p WHERE p.rn = {first} UNION ALL SELECT p.symbol, p.open_time, p.rn, {step} FROM {name} JOIN p ON p.symbol = {name}.symbol AND p.rn = {name}.rn + 1)"


def _recursive(group: str, columns: dict[str, str], ctes: str, source: str) -> None:
    inner = ", ".join(f"round(CAST({e} AS DOUBLE), 4) + 0.0 AS {c}" for c, e in columns.items())
    ORACLES[f"indicator_{group}"] = f"WITH RECURSIVE {BARS}, {_P}, {ctes} SELECT b.symbol, b.open_time, {inner} FROM bars b LEFT JOIN {source} e ON b.symbol = e.symbol AND b.open_time = e.open_time"


_gains = {f"{k}{n}": (f"greatest({s}p.d, 0)", _alpha(1 / n)) for n in (7, 14, 21) for k, s in (("g", ""), ("l", "-"))}
_recursive("rsi", {f"rsi_{n}": f"100 - 100 / (1 + g{n} / nullif(l{n}, 0))" for n in (7, 14, 21)}, _ewm(_gains, 2), "e")
_recursive("atr", {f"atr_{n}": f"a{n}" for n in (14, 20)}, _ewm({f"a{n}": ("p.tr", _alpha(1 / n)) for n in (14, 20)}), "e")
_macd = _ewm({"a": ("p.close", 1 / 6.5), "b": ("p.close", 1 / 13.5)}, name="ab")
_recursive(
    "macd",
    {"macd_hist_12_26_9": "line - s", "macd_line_12_26": "line"},
    f"{_macd}, ln AS (SELECT *, a - b AS line FROM ab), e AS (SELECT symbol, open_time, rn, line, line AS s FROM ln WHERE rn = 1 UNION ALL SELECT n.symbol, n.open_time, n.rn, n.line, e.s + (n.line - e.s) * 0.2 FROM e JOIN ln n ON n.symbol = e.symbol AND n.rn = e.rn + 1)",
    "e",
)
_adx = _ewm({"t": ("p.tr", _alpha(1 / 14)), "u": ("CASE WHEN p.up > 0 AND p.up > p.dn THEN p.up ELSE 0 END", _alpha(1 / 14)), "v": ("CASE WHEN p.dn > 0 AND p.dn > p.up THEN p.dn ELSE 0 END", _alpha(1 / 14))}, name="av")
# a missing value leaves the average as it is, and makes what came before weigh less in the next one
_recursive(
    "adx",
    {"adx_14": "w"},
    f"""{_adx}, pm AS (SELECT *, 100 * u / nullif(t, 0) AS plus, 100 * v / nullif(t, 0) AS minus FROM av), dx AS (SELECT *, 100 * abs(plus - minus) / nullif(plus + minus, 0) AS x FROM pm),
e AS (SELECT symbol, open_time, rn, x AS w, CAST(1 AS DOUBLE) AS wt FROM dx WHERE rn = 1
UNION ALL SELECT n.symbol, n.open_time, n.rn, CASE WHEN e.w IS NULL THEN n.x WHEN n.x IS NULL THEN e.w ELSE (e.wt * (13 / 14.0) * e.w + n.x / 14.0) / (e.wt * (13 / 14.0) + 1 / 14.0) END,
CASE WHEN e.w IS NOT NULL AND n.x IS NULL THEN e.wt * (13 / 14.0) ELSE 1 END FROM e JOIN dx n ON n.symbol = e.symbol AND n.rn = e.rn + 1)""",
    "e",
)

# ---- statistics over windows and splits ------------------------------------------------

ORACLES["rolling_rank_ic"] = f"""WITH {BARS}, f AS (SELECT * FROM (SELECT symbol, open_time, close - open AS x, lead(close) OVER ({AT}) / nullif(close, 0) - 1 AS y FROM bars) WHERE y IS NOT NULL),
n AS (SELECT *, row_number() OVER ({AT}) AS rn FROM f), w AS (SELECT a.symbol, a.open_time, a.rn AS i, b.rn AS j, b.x, b.y FROM n a JOIN n b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 47 AND a.rn),
k AS (SELECT symbol, open_time, row_number() OVER (PARTITION BY symbol, i ORDER BY x, j) - row_number() OVER (PARTITION BY symbol, i ORDER BY y, j) AS d FROM w),
s AS (SELECT symbol, open_time, sum(d * d) AS d2, count(*) AS m FROM k GROUP BY 1, 2) SELECT symbol, open_time, round(CASE WHEN m >= 10 THEN 1 - 6.0 * d2 / (m * (m * m - 1)) ELSE 0 END, 6) + 0.0 AS rank_ic FROM s"""

ORACLES["regime_rolling"] = f"""WITH {BARS}, c AS (SELECT *, close / nullif(lag(close, 48) OVER ({AT}), 0) - 1 AS ret, close / nullif(lag(close) OVER ({AT}), 0) - 1 AS r1, row_number() OVER ({AT}) AS rn FROM bars),
v AS (SELECT *, {full('stddev_samp', 'r1', 48, 10)} AS vol FROM c), k AS (SELECT a.symbol, a.open_time, (count_if(b.vol < a.vol) + 1 + count_if(b.vol <= a.vol)) / 2.0 / count(*) AS pct, count(*) AS n FROM v a JOIN v b ON a.symbol = b.symbol AND b.rn <= a.rn AND a.vol IS NOT NULL AND b.vol IS NOT NULL GROUP BY 1, 2)
SELECT v.symbol, v.open_time, CASE WHEN ret > 0.2 THEN 'bull' WHEN ret < -0.2 THEN 'bear' WHEN n >= 10 AND pct > 0.85 THEN 'high_vol' ELSE 'sideways' END AS regime FROM v LEFT JOIN k ON v.symbol = k.symbol AND v.open_time = k.open_time"""

ORACLES["pbo_cscv"] = f"""WITH {BARS}, {_POS}, c AS (SELECT candidate_id || '/' || symbol AS candidate_id, open_time, net_return FROM net),
r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY open_time) - 1 AS rn, count(*) OVER (PARTITION BY candidate_id) AS n FROM c),
per AS (SELECT candidate_id, least(7, floor(rn * 8 / n)) AS g, sum(net_return) AS s, sum(net_return * net_return) AS q, count(net_return) AS n FROM r GROUP BY 1, 2),
splits AS (SELECT m FROM range(256) t(m) WHERE bit_count(CAST(m AS INTEGER)) = 4 AND m % 2 = 1),
part AS (SELECT m, candidate_id, (m >> CAST(g AS INTEGER)) & 1 AS train, sum(s) AS s, sum(q) AS q, sum(n) AS n FROM per, splits GROUP BY ALL),
sc AS (SELECT m, candidate_id, train, coalesce(s / n / sqrt(CASE WHEN (q - s * s / n) / (n - 1) > 1e-18 THEN (q - s * s / n) / (n - 1) END), 0) AS score FROM part),
b AS (SELECT m, candidate_id, max(CASE WHEN train = 1 THEN score END) AS inside, max(CASE WHEN train = 0 THEN score END) AS outside FROM sc GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY inside DESC, candidate_id) AS k, cume_dist() OVER (PARTITION BY m ORDER BY outside) AS share FROM b),
ch AS (SELECT candidate_id, count(*) AS chosen, count_if(share < 0.5) AS poor FROM w WHERE k = 1 GROUP BY 1)
SELECT i.candidate_id, round(CASE WHEN chosen >= 3 THEN poor / chosen ELSE (SELECT sum(poor) / sum(chosen) FROM ch) END, 6) + 0.0 AS pbo FROM (SELECT DISTINCT candidate_id FROM c) i LEFT JOIN ch ON i.candidate_id = ch.candidate_id"""


@register("ic_summary", f"WITH {BARS}, {_PANEL}, o AS (SELECT * FROM pn WHERE factor IS NOT NULL AND fwd_ret IS NOT NULL), i AS (SELECT open_time, CASE WHEN count(*) >= 3 AND stddev_pop(factor) * stddev_pop(fwd_ret) > 1e-14 THEN corr(factor, fwd_ret) END AS ic FROM o GROUP BY 1) SELECT round(avg(ic), 6) + 0.0 AS ic_mean, round(stddev_samp(ic), 6) + 0.0 AS ic_vol, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS hit_rate, count(*) AS n FROM i WHERE ic IS NOT NULL")
def ic_summary(spark, sf_dir):
    return shown(panel.ic_summary(panel.ic(_panel(spark, sf_dir), method="pearson")), "ic_mean", "ic_vol", "hit_rate", "n", keys=())


@register("pnl_matrix", f"WITH {BARS}, {_POS}, f AS (SELECT candidate_id || symbol AS factor_id, open_time, net_return FROM net), g AS (SELECT * FROM (SELECT DISTINCT factor_id FROM f), (SELECT DISTINCT open_time FROM f)) SELECT g.factor_id, g.open_time, round(coalesce(net_return, 0), 6) + 0.0 AS net_return FROM g LEFT JOIN f ON g.factor_id = f.factor_id AND g.open_time = f.open_time")
def pnl_matrix(spark, sf_dir):
    p = simple_path(spark, sf_dir).withColumn("factor_id", F.concat("candidate_id", "symbol"))
    return shown(panel.pnl_matrix(p), "net_return", keys=("factor_id", "open_time"))


@register("equity_curve", f"WITH {BARS}, {_POS}, e AS (SELECT candidate_id, symbol, open_time, product(1 + coalesce(net_return, 0)) OVER (PARTITION BY candidate_id, symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING) AS equity, row_number() OVER (PARTITION BY candidate_id, symbol ORDER BY open_time) - 1 AS rn, count(*) OVER (PARTITION BY candidate_id, symbol) AS n FROM net), k AS (SELECT DISTINCT n, round_even(k * (n - 1) / 63.0, 0) AS rn FROM range(64) t(k), (SELECT DISTINCT n FROM e)) SELECT candidate_id, symbol, open_time, round(equity, 6) + 0.0 AS equity FROM e WHERE n <= 64 OR EXISTS (SELECT 1 FROM k WHERE k.n = e.n AND k.rn = e.rn)")
def equity_curve(spark, sf_dir):
    return shown(simulate.equity_curve(simple_path(spark, sf_dir), points=64), "equity", keys=_KEYS)


# ---- signals -------------------------------------------------------------------


def _wide(name: str, run, sql: str) -> None:
    QUERIES[f"signal_{name}"] = lambda spark, sf_dir: shown(run(spark, sf_dir), "signal")
    ORACLES[f"signal_{name}"] = sql


_wide("raw_clip", lambda spark, sf_dir: signals.transform(hourly(spark, sf_dir).withColumn("x", (F.col("close") - F.col("open")) / 40), "x", how="raw_clip", direction=-1), out({"signal": "-greatest(-1, least(1, (close - open) / 40))"}, "bars"))
# the average's weights add up to 1 from the first row: numerator and denominator are states of their own
_wide(
    "tanh_zscore",
    lambda spark, sf_dir: signals.transform(hourly(spark, sf_dir), "close", window=50),
    f"""WITH RECURSIVE {BARS}, p AS (SELECT symbol, open_time, row_number() OVER ({AT}) AS rn, coalesce({z('close', 50, 20)}, 0) AS x FROM bars),
e AS (SELECT symbol, open_time, rn, x AS num, CAST(1 AS DOUBLE) AS den FROM p WHERE rn = 1 UNION ALL SELECT p.symbol, p.open_time, p.rn, p.x + e.num * (11 / 13.0), 1 + e.den * (11 / 13.0) FROM e JOIN p ON p.symbol = e.symbol AND p.rn = e.rn + 1)
SELECT symbol, open_time, round(tanh(num / den / 2), 6) + 0.0 AS signal FROM e""",
)
_FUNDED = f"{_EVENTS}, fu AS (SELECT b.symbol, b.open_time, coalesce(e.rate, 0) AS zs FROM bars b ASOF LEFT JOIN ev e ON b.symbol = e.symbol AND b.open_time >= e.calc_time)"


def _funded(spark, sf_dir):
    return joins.as_of(hourly(spark, sf_dir), funding_events(spark, sf_dir), "rate", name="funding_zscore", default=0.0)


_wide("funding_basis", lambda spark, sf_dir: signals.factor_signal(_funded(spark, sf_dir), "funding_basis", 20), out({"signal": "-tanh(greatest(-6, least(6, zs)) / 2)"}, "fu", _FUNDED))


@register("funding_labels", f"WITH {BARS}, {_FUNDED}, s AS (SELECT *, zs - coalesce(lag(zs) OVER ({AT}), zs) AS step, max(abs(zs)) OVER (PARTITION BY symbol) > 0 AS usable FROM fu) SELECT symbol, open_time, CASE WHEN NOT usable THEN 'unavailable' WHEN zs <= -1.5 THEN 'very_negative' WHEN zs <= -0.5 THEN 'negative' WHEN zs >= 1.5 THEN 'very_positive' WHEN zs >= 0.5 THEN 'positive' ELSE 'neutral' END AS funding_state, CASE WHEN NOT usable THEN 'unavailable' WHEN step > 0.05 THEN 'rising' WHEN step < -0.05 THEN 'falling' ELSE 'flat' END AS funding_trend FROM s")
def funding_labels(spark, sf_dir):
    return shown(signals.with_funding_labels(_funded(spark, sf_dir)), "funding_state", "funding_trend")


@register("label_filter", f"WITH {BARS} SELECT symbol, open_time, round(CASE WHEN {_regimed} IN ('bull', 'sideways') THEN tanh((close - low) / 50 - 1) ELSE 0 END, 6) + 0.0 AS signal FROM bars")
def label_filter(spark, sf_dir):
    return shown(quality.keep_labels(_with_regime(hourly(spark, sf_dir)), "regime", ["bull", "sideways"]), "signal")


@register("empty_signal", f"WITH {BARS}, {_TWO}, t AS (SELECT * FROM sg UNION ALL SELECT 'flat', symbol, open_time, 0.25 FROM bars UNION ALL SELECT 'none', symbol, open_time, NULL FROM bars) SELECT candidate_id, count(signal) = 0 OR coalesce(sum(abs(signal)), 0) < 1e-12 OR coalesce(stddev_pop(signal), 0) < 1e-12 AS empty FROM t GROUP BY 1")
def empty_signal(spark, sf_dir):
    b = hourly(spark, sf_dir).select("symbol", "open_time")
    more = b.select(F.explode(F.map_from_arrays(F.array(F.lit("flat"), F.lit("none")), F.array(F.lit(0.25), F.lit(None).cast("double")))).alias("candidate_id", "signal"), "symbol", "open_time")
    return signals.empty(two_signals(spark, sf_dir).unionByName(more))


@register("parent_correlation", f"WITH {BARS}, {_TWO} SELECT 'b' AS candidate_id, 'a' AS parent_id, round(abs(corr(x.signal, y.signal)), 6) + 0.0 AS corr FROM sg x JOIN sg y ON x.symbol = y.symbol AND x.open_time = y.open_time AND x.candidate_id = 'a' AND y.candidate_id = 'b'")
def parent_correlation(spark, sf_dir):
    family = spark.createDataFrame([("a", None), ("b", "a")], "candidate_id string, parent_id string")
    return shown(joins.against_parent(two_signals(spark, sf_dir), family), "corr", keys=("candidate_id", "parent_id"))


@register("strict_zip", f"WITH {BARS} SELECT open_time, round(x.close, 6) + 0.0 AS x, round(y.n, 6) + 0.0 AS y FROM (SELECT open_time, max(close) AS close FROM bars GROUP BY 1) x JOIN (SELECT open_time, sum(volume) AS n FROM bars GROUP BY 1) y USING (open_time)")
def strict_zip(spark, sf_dir):
    b = hourly(spark, sf_dir).groupBy("open_time")
    return shown(joins.strict_zip(b.agg(F.max("close").alias("x")), b.agg(F.sum("volume").alias("y")), "open_time"), "x", "y", keys=("open_time",))


# ---- scans and calendars ---------------------------------------------------------


@register("month_range", "SELECT year(d) AS year, month(d) AS month FROM (SELECT unnest(generate_series(DATE '2023-11-01', DATE '2025-02-01', INTERVAL 1 MONTH)) AS d)")
def month_range(spark, sf_dir):
    return src.months(spark, "2023-11-15", "2025-02-03")


@register("universe_preset", "SELECT unnest(['BTCUSDT', 'ETHUSDT', 'XRPUSDT']) AS symbol")
def universe_preset(spark, sf_dir):
    return src.universe(spark, symbols=[" btcusdt", "ETHUSDT", "btcUSDT ", "", "xrpusdt"])


@register("partition_months", f"WITH {BARS} SELECT DISTINCT symbol, year(make_timestamp(open_time * 1000)) AS year, month(make_timestamp(open_time * 1000)) AS month FROM bars")
def partition_months(spark, sf_dir):
    at = F.timestamp_millis("open_time")
    return hourly(spark, sf_dir).select("symbol", F.year(at).alias("year"), F.month(at).alias("month")).distinct()


@register("split_counts", f"WITH {BARS}, {_SPLIT} SELECT symbol, CASE WHEN rn < beg - gap THEN 'discovery' WHEN rn < beg THEN 'gap' WHEN rn < fin - gap THEN 'validation' WHEN rn < fin THEN 'gap' ELSE 'holdout' END AS split, count(*) AS n FROM g GROUP BY 1, 2")
def split_counts(spark, sf_dir):
    return quality.split_plan(hourly(spark, sf_dir), gap=10).groupBy("symbol", "split").agg(F.count(F.lit(1)).alias("n"))


# ---- rules ---------------------------------------------------------------------

_ALONE = ORACLES["gatecheck"].rsplit(" SELECT experiment_id, rule_id", 1)[0]


@register("raw_pass", f"{_ALONE} SELECT experiment_id, count_if(status = 'fail') = 0 AS raw_passed, coalesce(string_agg(CASE WHEN status = 'fail' THEN rule_id END, ',' ORDER BY rule_id), '') AS blocking_failures, count_if(status = 'warn') AS warnings FROM items GROUP BY 1")
def raw_pass(spark, sf_dir):
    return rules.raw_pass(rules.gates(results(spark, sf_dir)))


#: The p-value of each row without a family: the smaller one-sided p of two, doubled; the table is only over t = 0, 0.5 .. 4.
@register("g3_without_family", f"WITH {_RESULTS}, t AS (SELECT experiment_id, greatest(ic_tstat, rankic_tstat) AS t FROM res) SELECT experiment_id, CASE WHEN t >= 2 THEN 'pass' ELSE 'warn' END AS status FROM t")
def g3_without_family(spark, sf_dir):
    items = rules.gates(results(spark, sf_dir).drop("fdr_p"))
    return items.where("rule_id = 'G3'").select("experiment_id", "status")


_MADE = "SELECT o_custkey % 97 AS experiment_id, 'r' || (o_orderkey % 4) AS regime, CAST(count(*) AS BIGINT) AS trade_count, sum(o_totalprice - 150000) AS pnl FROM orders GROUP BY 1, 2"


@register("regime_spread", f"WITH m AS ({_MADE}), t AS (SELECT *, sum(trade_count) OVER (PARTITION BY experiment_id) AS total FROM m), g AS (SELECT *, CASE WHEN trade_count / greatest(total, 1) >= 0.05 THEN greatest(0, pnl) END AS gain FROM t), a AS (SELECT experiment_id, max(total) AS t, max(gain) AS m, sum(gain) AS s, count(gain) AS n FROM g GROUP BY 1) SELECT experiment_id, round(CASE WHEN t = 0 OR n = 0 THEN 0 WHEN s <= 0 THEN 1 ELSE m / nullif(s, 0) END, 6) + 0.0 AS regime_share, round(CASE WHEN t = 0 THEN 0 ELSE coalesce(greatest(0, least(1, (1 - m / nullif(s, 0)) / (1 - 1.0 / CASE WHEN n > 1 THEN n END))), 0) END, 6) + 0.0 AS regime_diversity FROM a")
def regime_spread(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 97).alias("experiment_id"), F.concat(F.lit("r"), F.col("o_orderkey") % 4).alias("regime"))
    m = o.agg(F.count(F.lit(1)).alias("trade_count"), F.sum(F.col("o_totalprice") - 150000).alias("pnl"))
    return shown(rules.regime_spread(m), "regime_share", "regime_diversity", keys=("experiment_id",))


_STORE = "st AS (SELECT c_custkey AS candidate_id, CASE c_custkey % 5 WHEN 0 THEN 'retired' ELSE 'active' END AS status, CAST(c_custkey % 3 AS INTEGER) AS failures, c_custkey % 200 AS elapsed_days FROM customer), ck AS (SELECT c_custkey AS candidate_id, CASE c_custkey % 4 WHEN 0 THEN 'production_passed' WHEN 1 THEN 'rejected' ELSE 'research_survivor' END AS research_status, c_custkey % 250 AS oos_trades, (c_custkey % 30) / 100.0 AS fdr_p, c_custkey % 7 - 2.0 AS cost_margin_bps, c_custkey % 9 - 3.0 AS net_sharpe FROM customer WHERE c_custkey % 11 <> 0)"


@register("survivor_lifecycle", f"WITH {_STORE}, j AS (SELECT st.*, research_status, oos_trades, coalesce(research_status = 'production_passed' OR (fdr_p < 0.10 AND oos_trades >= 100 AND elapsed_days >= 90 AND cost_margin_bps > 0 AND net_sharpe > 0), false) AS won, status = 'active' AND research_status IS NOT NULL AS live FROM st LEFT JOIN ck USING (candidate_id)) SELECT candidate_id, CASE WHEN live AND won THEN 'promoted' WHEN live AND research_status = 'rejected' AND (oos_trades >= 100 OR failures + 1 >= 3) THEN 'retired' ELSE status END AS status, CAST(CASE WHEN NOT live THEN failures WHEN research_status = 'rejected' THEN failures + 1 ELSE 0 END AS INTEGER) AS failures, elapsed_days FROM j")
def survivor_lifecycle(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    store = c.select(k.alias("candidate_id"), F.when(k % 5 == 0, "retired").otherwise("active").alias("status"), (k % 3).cast("int").alias("failures"), (k % 200).alias("elapsed_days"))
    status = F.when(k % 4 == 0, "production_passed").when(k % 4 == 1, "rejected").otherwise("research_survivor")
    checked = c.where(k % 11 != 0).select(k.alias("candidate_id"), status.alias("research_status"), (k % 250).alias("oos_trades"), (k % 30 / 100).alias("fdr_p"), (k % 7 - 2.0).alias("cost_margin_bps"), (k % 9 - 3.0).alias("net_sharpe"))
    return rules.lifecycle(store, checked)


# ---- search ----------------------------------------------------------------------

_METHOD_ROWS = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in methods.rows())
ORACLES["method_registry"] = f"SELECT method_id, family, status, CAST(min_universe AS INTEGER) AS min_universe, cross_section, orderbook, is_ml FROM (VALUES {_METHOD_ROWS}) t(method_id, family, status, min_universe, cross_section, orderbook, is_ml)"


@register("schedulable_methods", f"SELECT method_id, family FROM ({ORACLES['method_registry']}) WHERE status = 'implemented' AND min_universe <= 2 AND NOT cross_section")
def schedulable_methods(spark, sf_dir):
    return methods.schedulable(spark, 2).select("method_id", "family")


@register("cross_candidates", "WITH h AS (SELECT 'h' || p_partkey AS hypothesis_id, 'f' || (p_partkey % 3) AS family FROM part), i AS (SELECT 'f' || (s_suppkey % 3) AS family, 'i' || s_suppkey AS indicator FROM supplier), s AS (SELECT DISTINCT event_type AS symbol FROM events), v AS (SELECT unnest(['base', 'inverse', 'low_turnover']) AS variant) SELECT hypothesis_id, symbol, indicator, variant, substr(sha256(hypothesis_id || '|' || symbol || '|' || indicator || '|' || variant), 1, 16) AS candidate_id FROM h JOIN i USING (family), s, v")
def cross_candidates(spark, sf_dir):
    h = table(spark, sf_dir, "part").select(F.concat(F.lit("h"), "p_partkey").alias("hypothesis_id"), F.concat(F.lit("f"), F.col("p_partkey") % 3).alias("family"))
    i = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey") % 3).alias("family"), F.concat(F.lit("i"), "s_suppkey").alias("indicator"))
    s = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct()
    return search.cross_candidates(h, s, i).select("hypothesis_id", "symbol", "indicator", "variant", "candidate_id")


@register("acquisition_score", "WITH g AS (SELECT o_orderkey AS candidate_id, o_orderkey % 5 / 4.0 AS priority, o_orderkey % 7 / 6.0 AS severity, o_orderkey % 6 AS complexity, o_orderkey % 4 AS changes, o_orderkey % 100 AS smooth_span, o_orderkey % 3 / 10.0 AS signal_threshold, o_orderkey % 5 / 20.0 AS position_buffer, o_orderkey % 2 / 10.0 AS entry_band FROM orders) SELECT candidate_id, round(priority + (0.45 * severity - 0.10) * (log2(greatest(1.0, smooth_span)) + 4 * signal_threshold + 2 * position_buffer + 4 * entry_band) + 0.05 * changes - 0.25 * greatest(0, complexity - 2), 6) + 0.0 AS score FROM g")
def acquisition_score(spark, sf_dir):
    k = F.col("o_orderkey")
    g = table(spark, sf_dir, "orders").select(k.alias("candidate_id"), (k % 5 / 4).alias("priority"), (k % 7 / 6).alias("severity"), (k % 6).alias("complexity"), (k % 4).alias("changes"), (k % 100).alias("smooth_span"), (k % 3 / 10).alias("signal_threshold"), (k % 5 / 20).alias("position_buffer"), (k % 2 / 10).alias("entry_band"))
    return shown(g.withColumn("score", search.acquisition(*[F.col(c) for c in ("priority", "severity", "complexity", "changes")])), "score", keys=("candidate_id",))


@register("composite_pairs", "WITH t AS (SELECT o_orderkey AS candidate_id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 8), p AS (SELECT a.candidate_id AS a, b.candidate_id AS b FROM t a JOIN t b ON a.candidate_id < b.candidate_id) SELECT a || '+' || b AS composite_id, unnest([a, b]) AS candidate_id FROM p")
def composite_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.col("o_totalprice").alias("score"))
    return search.pairs(o, 8)


@register("clamp_exits", "WITH e AS (SELECT o_orderkey AS k, o_orderkey % 40 / 100.0 - 0.35 AS stop, CAST(o_orderkey % 3000 - 100 AS INTEGER) AS hold, o_orderkey % 15 / 100.0 - 0.02 AS trail FROM orders) SELECT k, round(CAST(CASE WHEN stop >= 0 THEN 0 ELSE greatest(-0.15, least(-0.01, stop)) END AS DOUBLE), 6) + 0.0 AS stop_loss_pct, CAST(CASE WHEN hold <= 0 THEN 0 ELSE greatest(10, least(2000, hold)) END AS INTEGER) AS max_hold_bars, round(CAST(CASE WHEN trail <= 0 THEN 0 ELSE greatest(0.005, least(0.10, trail)) END AS DOUBLE), 6) + 0.0 AS trailing_stop_pct FROM e")
def clamp_exits(spark, sf_dir):
    k = F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").select(k.alias("k"), (k % 40 / 100 - 0.35).alias("stop_loss_pct"), (k % 3000 - 100).cast("int").alias("max_hold_bars"), (k % 15 / 100 - 0.02).alias("trailing_stop_pct"))
    return shown(search.clamp_exits(e), "stop_loss_pct", "max_hold_bars", "trailing_stop_pct", keys=("k",))


@register("outcome_status", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 - 2 > 0 OR o_orderkey % 7 / 10.0 - 0.35 > 0.1 THEN 'improved' WHEN o_orderkey % 5 - 2 < 0 OR o_orderkey % 7 / 10.0 - 0.35 < -0.1 THEN 'failed' ELSE 'neutral' END AS outcome FROM orders")
def outcome_status(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("k"), search.outcome(k % 5 - 2, k % 7 / 10 - 0.35).alias("outcome"))


@register("first_per_family", "SELECT family, candidate_id FROM (SELECT o_orderpriority AS family, o_orderkey AS candidate_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 5")
def first_per_family(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("family"), F.col("o_orderkey").alias("candidate_id"), "o_totalprice")
    return quality.first_per_family(o, "family", [F.col("o_totalprice").desc(), "candidate_id"], 5).select("family", "candidate_id")


# ---- metadata ----------------------------------------------------------------------


def _trials(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("trial_id"), F.concat(F.lit(" F"), k % 4).alias("family"), F.concat(F.lit("c"), "o_custkey").alias("candidate_id"), F.when(k % 3 == 0, F.concat(F.lit("old-"), k % 9)).alias("lineage_id"), F.col("o_orderdate").cast("timestamp").alias("evaluated_at"))


_TR = "tr AS (SELECT o_orderkey AS trial_id, ' F' || (o_orderkey % 4) AS family, 'c' || o_custkey AS candidate_id, CASE WHEN o_orderkey % 3 = 0 THEN 'old-' || (o_orderkey % 9) END AS lineage_id, o_orderdate AS evaluated_at FROM orders)"


@register("record_trials", f"WITH {_TR} SELECT trial_id, lower(trim(family)) AS family, candidate_id, coalesce(lineage_id, candidate_id) AS lineage_id FROM tr WHERE trial_id % 5 <> 0")
def record_trials(spark, sf_dir):
    t = _trials(spark, sf_dir)
    return ledger.record_trials(t.where("trial_id % 5 = 0"), t.unionByName(t.where("trial_id % 7 = 0"))).select("trial_id", "family", "candidate_id", "lineage_id")


@register("migrate_lineage", f"WITH {_TR} SELECT trial_id, CASE WHEN lineage_id LIKE 'old-3%' OR lineage_id = 'old-6' THEN 'legacy' ELSE lineage_id END AS lineage_id FROM tr")
def migrate_lineage(spark, sf_dir):
    return ledger.migrate_lineage(_trials(spark, sf_dir), ["old-3*", "old-6"]).select("trial_id", "lineage_id")


@register("archive_trials", f"WITH {_TR}, d AS (SELECT max(evaluated_at) - INTERVAL 365 DAY AS d FROM tr) SELECT trial_id, evaluated_at < (SELECT d FROM d) AS archived FROM tr")
def archive_trials(spark, sf_dir):
    t = _trials(spark, sf_dir)
    before = t.agg(F.max("evaluated_at") - F.expr("interval 365 days")).scalar()
    kept, old = ledger.archive(t, before)
    return kept.select("trial_id", F.lit(False).alias("archived")).unionByName(old.select("trial_id", F.lit(True).alias("archived")))


@register("delete_by_prefix", "SELECT p_partkey AS id, p_brand AS key FROM part WHERE p_brand NOT LIKE 'Brand#1%'")
def delete_by_prefix(spark, sf_dir):
    return ledger.delete_prefix(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("key")), "Brand#1")


@register("prune_artifacts", "SELECT o_orderkey AS key FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200) OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def prune_artifacts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("updated_at"))
    held = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("key"))
    return ledger.prune(o, 200, held).select("key")


@register("top_candidates", "SELECT o_orderkey AS k, o_orderdate AS updated_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def top_candidates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("updated_at"))
    return ledger.newest(o, 25)


@register("survivor_upsert", "SELECT coalesce(a.c_custkey, b.o_custkey) AS candidate_id, coalesce(b.score, a.c_acctbal) AS score, coalesce(a.c_nationkey, b.day) AS paper_trade_start FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) a FULL OUTER JOIN (SELECT o_custkey, max(o_totalprice) AS score, CAST(min(o_orderkey) AS INTEGER) AS day FROM orders GROUP BY 1) b ON a.c_custkey = b.o_custkey")
def survivor_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("candidate_id"), F.col("c_acctbal").alias("score"), F.col("c_nationkey").alias("paper_trade_start"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("candidate_id")).agg(F.max("o_totalprice").alias("score"), F.min("o_orderkey").cast("int").alias("paper_trade_start"))
    return ledger.upsert_survivors(old, new)


# ---- proposals -----------------------------------------------------------------------
# Made-up factors from orders: every field is a plain function of the key.

_FACTOR = {
    "passed": "k % 17 = 0", "research_score": "(k % 50) / 20.0", "gross_sharpe": "(k % 23) / 20.0 - 0.6", "net_sharpe": "(k % 19) / 10.0 - 1", "cost_margin_bps": "(k % 13) - 9.0", "turnover": "(k % 37) / 100.0 + 0.01",
    "ic_tstat": "(k % 11) / 4.0 - 1.3", "rankic_tstat": "(k % 7) / 4.0", "cost_drag": "(k % 9) / 10.0", "max_drawdown": "-(k % 21) / 100.0", "avg_holding": "(k % 31) * 30.0", "trade_count": "k % 120",
    "smooth_span": "CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 12 WHEN 2 THEN 24 WHEN 3 THEN 48 ELSE 96 END", "signal_threshold": "(k % 5) / 10.0", "position_buffer": "(k % 4) / 10.0 + 0.05",
    "lookback": "CASE k % 6 WHEN 0 THEN 6 WHEN 1 THEN 12 WHEN 2 THEN 24 WHEN 3 THEN 48 WHEN 4 THEN 96 ELSE 7 END", "best_regime_sharpe": "(k % 29) / 10.0 - 0.5",
}
_FACTORS = "fa AS (SELECT 'c' || o_orderkey AS candidate_id, 'f' || (o_orderkey % 4) AS family, 'bull' AS best_regime, " + ", ".join(f"{e} AS {n}" for n, e in _FACTOR.items()) + " FROM (SELECT *, o_orderkey AS k FROM orders))"
_MERIT = "passed DESC, coalesce(nullif(research_score, 0), -999) DESC, gross_sharpe DESC, coalesce(nullif(cost_margin_bps, 0), -999) DESC, turnover, candidate_id"
_SIGNS = "(passed OR research_score >= 1.5 OR gross_sharpe >= 0.5 OR greatest(abs(ic_tstat), abs(rankic_tstat)) >= 1.5 OR (cost_margin_bps > 0 AND net_sharpe > 0))"


def _factors(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return o.select(F.concat(F.lit("c"), "k").alias("candidate_id"), F.concat(F.lit("f"), F.col("k") % 4).alias("family"), F.lit("bull").alias("best_regime"), *[F.expr(e).cast(proposals.NEEDS[n]).alias(n) for n, e in _FACTOR.items()])


@register("composite_pool", f"WITH {_FACTORS}, p AS (SELECT *, row_number() OVER (ORDER BY {_MERIT}) AS place FROM fa WHERE {_SIGNS}) SELECT candidate_id, CAST(place AS INTEGER) AS place, place <= 8 AND (passed OR NOT (SELECT bool_or(passed) FROM p)) AS selected FROM p WHERE place <= 24")
def composite_pool(spark, sf_dir):
    return proposals.composite_pool(_factors(spark, sf_dir)).select("candidate_id", "place", "selected")


_STRENGTH = "greatest(abs(ic_tstat), abs(rankic_tstat))"
_SETS = [
    ("top8", "traditional", "place <= 8 AND (passed OR NOT (SELECT bool_or(passed) FROM pool))"), ("top4", "equal", "place <= 4"), ("top4", "inverse_turnover", "place <= 4"), ("diverse8", "traditional", "mixed <= 8"),
    ("low_turnover8", "inverse_turnover", "calm <= 8"), ("high_ic8", "ic", "strong <= 8"),
]
_CALM = "1 / greatest(0.02, least(1.0, turnover))"
_FALLBACK = f"greatest(0.25, least(4.0, coalesce(nullif({_STRENGTH}, 0), nullif(research_score, 0), nullif(gross_sharpe, 0), 1.0))) * {_CALM}"
_RAW = {"traditional": _FALLBACK, "equal": "1.0", "inverse_turnover": _CALM, "ic": _STRENGTH}
_COMPOSITES = f"""WITH {_FACTORS}, p AS (SELECT *, row_number() OVER (ORDER BY {_MERIT}) AS place FROM fa WHERE {_SIGNS}), t AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY place) AS turn FROM p WHERE place <= 24),
pool AS (SELECT *, row_number() OVER (ORDER BY turn, place) AS mixed, row_number() OVER (ORDER BY turnover, research_score DESC, place) AS calm, row_number() OVER (ORDER BY {_STRENGTH} DESC, place) AS strong FROM t),
w AS ({" UNION ALL ".join(f"SELECT {k + 1} AS composite_id, '{s}' AS subset, '{h}' AS weighting, candidate_id, CAST({_RAW[h]} AS DOUBLE) AS raw FROM pool WHERE {c}" for k, (s, h, c) in enumerate(_SETS))}),
n AS (SELECT composite_id, subset, weighting, candidate_id, raw / sum(raw) OVER (PARTITION BY composite_id) AS weight FROM w),
g AS (SELECT 6 + row_number() OVER (ORDER BY a.place, b.place, v) AS composite_id, a.candidate_id AS a, b.candidate_id AS b, v FROM pool a, pool b, (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS v) WHERE a.place < b.place AND b.place <= 4)
SELECT CAST(composite_id AS INTEGER) AS composite_id, subset, weighting, candidate_id, round(CAST(weight AS DOUBLE), 6) + 0.0 AS weight FROM (SELECT * FROM n UNION ALL SELECT composite_id, 'pair_grid', 'grid_' || CAST(round(v * 100) AS INTEGER) || '_' || CAST(round((1 - v) * 100) AS INTEGER), unnest([a, b]), unnest([v, 1 - v]) FROM g WHERE composite_id <= 12)"""


@register("composite_combinations", _COMPOSITES)
def composite_combinations(spark, sf_dir):
    return shown(proposals.composites(_factors(spark, sf_dir)), "weight", keys=("composite_id", "subset", "weighting", "candidate_id"))


_COSTLY = "(turnover >= 0.15 OR cost_drag >= 0.5)"
_CALMER = {"smooth_span": f"CASE WHEN {_COSTLY} THEN 48 ELSE 24 END", "signal_threshold": f"CASE WHEN {_COSTLY} THEN 0.25 ELSE 0.15 END", "position_buffer": f"CASE WHEN {_COSTLY} THEN 0.20 ELSE 0.12 END"}
_CALMED = ", ".join(f"CASE WHEN {c} < {g} THEN {g} END AS {c}2" for c, g in _CALMER.items())
_NEXT = "CASE lookback WHEN 6 THEN 12 WHEN 12 THEN 24 WHEN 24 THEN 48 WHEN 48 THEN 96 WHEN 96 THEN 48 END"


@register("survivor_evolution", f"WITH {_FACTORS}, b AS (SELECT *, {_CALMED}, {_NEXT} AS lookback2 FROM fa WHERE passed ORDER BY {_MERIT} LIMIT 16), a AS (SELECT candidate_id, 'low_turnover' AS variant, smooth_span2 AS smooth_span, signal_threshold2 AS signal_threshold, position_buffer2 AS position_buffer, NULL AS lookback, NULL AS regime_filter FROM b WHERE coalesce(smooth_span2, signal_threshold2, position_buffer2) IS NOT NULL UNION ALL SELECT candidate_id, 'lookback', NULL, NULL, NULL, lookback2, NULL FROM b WHERE lookback2 IS NOT NULL UNION ALL SELECT candidate_id, 'regime_filter', NULL, NULL, NULL, NULL, best_regime FROM b WHERE best_regime_sharpe >= greatest(0.4, net_sharpe + 0.5)) SELECT candidate_id, variant, CAST(smooth_span AS BIGINT) AS smooth_span, round(CAST(signal_threshold AS DOUBLE), 6) + 0.0 AS signal_threshold, round(CAST(position_buffer AS DOUBLE), 6) + 0.0 AS position_buffer, CAST(lookback AS BIGINT) AS lookback, regime_filter FROM a")
def survivor_evolution(spark, sf_dir):
    return shown(proposals.evolve(_factors(spark, sf_dir)), "smooth_span", "signal_threshold", "position_buffer", "lookback", "regime_filter", keys=("candidate_id", "variant"))


_EXITS = [
    ("drawdown_balanced", "max_drawdown <= -0.12", "-0.03", "0.02", "NULL", "NULL"), ("drawdown_tight", "max_drawdown <= -0.12", "-0.02", "0.015", "NULL", "NULL"), ("drawdown_moderate", "max_drawdown <= -0.08 AND max_drawdown > -0.12", "-0.04", "0.025", "NULL", "NULL"),
    ("max_hold_500", "avg_holding > 500", "NULL", "NULL", "500", "NULL"), ("max_hold_250", "avg_holding > 500", "NULL", "NULL", "250", "NULL"), ("profit_lock_balanced", "cost_drag > 0.5 AND trade_count >= 50", "NULL", "NULL", "NULL", "0.02"), ("profit_lock_fast", "cost_drag > 0.5 AND trade_count >= 50", "NULL", "0.015", "NULL", "0.01"),
]


@register("exit_proposals", f"WITH {_FACTORS}, b AS (SELECT * FROM fa WHERE {_SIGNS} ORDER BY {_MERIT} LIMIT 8), e AS (" + " UNION ALL ".join(f"SELECT candidate_id, {k} AS k, '{v}' AS variant, CAST({s} AS DOUBLE) AS stop_loss_pct, CAST({t} AS DOUBLE) AS trailing_stop_pct, CAST({h} AS INTEGER) AS max_hold_bars, CAST({p} AS DOUBLE) AS tp_tier_pct FROM b WHERE {w}" for k, (v, w, s, t, h, p) in enumerate(_EXITS)) + ") SELECT * EXCLUDE (k, n) FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY k) AS n FROM e) WHERE n <= 3")
def exit_proposals(spark, sf_dir):
    return shown(proposals.exits(_factors(spark, sf_dir)), "stop_loss_pct", "trailing_stop_pct", "max_hold_bars", "tp_tier_pct", keys=("candidate_id", "variant"))


_STEPS = " ".join(f"WHEN smooth_span < {a} OR signal_threshold < {b} OR position_buffer < {c} THEN {a}" for a, b, c in proposals.CALM_STEPS)


@register("hill_climb", f"WITH {_FACTORS}, o AS (SELECT 'c' || o_orderkey AS candidate_id, o_orderkey % 3 AS what, o_orderkey % 21 / 100.0 - 0.06 AS delta_sharpe, o_orderkey % 8 / 100.0 - 0.05 AS delta_turnover FROM orders WHERE o_orderkey % 4 <> 1), h AS (SELECT fa.*, what, delta_sharpe, delta_turnover, CASE {_STEPS} END AS step, {_CALMED}, {_NEXT} AS lookback2 FROM fa JOIN o USING (candidate_id)) SELECT candidate_id, 'turnover' AS variant, CAST(step AS BIGINT) AS smooth_span, CAST(NULL AS BIGINT) AS lookback FROM h WHERE what = 0 AND delta_sharpe >= -0.05 AND delta_turnover <= -0.01 AND step IS NOT NULL UNION ALL SELECT candidate_id, 'lookback', NULL, lookback2 FROM h WHERE what = 1 AND delta_sharpe >= 0.05 AND lookback2 IS NOT NULL UNION ALL SELECT candidate_id, 'regime_filter', smooth_span2, NULL FROM h WHERE what = 2 AND delta_sharpe >= 0.05 AND coalesce(smooth_span2, signal_threshold2, position_buffer2) IS NOT NULL")
def hill_climb(spark, sf_dir):
    k = F.col("o_orderkey")
    names = F.array(F.lit("position_buffer"), F.lit("lookback"), F.lit("regime_filter"))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_orderkey").alias("candidate_id"), F.when(k % 4 == 1, "failed").otherwise("improved").alias("status"), F.array(F.get(names, k % 3)).alias("changed"), F.expr("o_orderkey % 21 / 100.0 - 0.06").cast("double").alias("delta_sharpe"), F.expr("o_orderkey % 8 / 100.0 - 0.05").cast("double").alias("delta_turnover"))
    return shown(proposals.hill_climb(_factors(spark, sf_dir), o), "smooth_span", "lookback", keys=("candidate_id", "variant"))


# ---- calibration ---------------------------------------------------------------------


@register("gate_rates", f"{_ALONE}, t AS (SELECT 'arm' || (experiment_id % 3) AS arm, experiment_id AS trial, rule_id AS gate, status = 'pass' AS ok FROM items WHERE rule_id IN ('G1', 'G3', 'G5')), b AS (SELECT arm, gate, ok FROM t UNION ALL SELECT arm, 'ALL', bool_and(ok) FROM t GROUP BY arm, trial) SELECT arm, gate, count(*) AS n, count_if(ok) AS passed, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS rate FROM b GROUP BY 1, 2")
def gate_rates(spark, sf_dir):
    items = rules.gates(results(spark, sf_dir)).select(F.concat(F.lit("arm"), F.col("experiment_id") % 3).alias("arm"), F.col("experiment_id").alias("trial"), "rule_id", "status")
    return shown(inference.gate_rates(items, ("G1", "G3", "G5")), "n", "passed", "rate", keys=("arm", "gate"))


@register("unfunded_filter", f"WITH {BARS}, c AS (SELECT o_orderkey AS candidate_id, CASE o_orderkey % 3 WHEN 0 THEN 'funding_basis' ELSE 'momentum' END AS family, CASE WHEN o_orderkey % 5 = 0 THEN 'TS_MEAN($funding_rate, 5)' ELSE '$close' END AS expression, CASE o_orderkey % 2 WHEN 0 THEN 'click' ELSE 'view' END AS symbol FROM orders) SELECT candidate_id FROM c WHERE symbol = 'click' OR (family <> 'funding_basis' AND expression = '$close')")
def unfunded_filter(spark, sf_dir):
    k = F.col("o_orderkey")
    c = table(spark, sf_dir, "orders").select(k.alias("candidate_id"), F.when(k % 3 == 0, "funding_basis").otherwise("momentum").alias("family"), F.when(k % 5 == 0, "TS_MEAN($funding_rate, 5)").otherwise("$close").alias("expression"), F.when(k % 2 == 0, "click").otherwise("view").alias("symbol"))
    b = hourly(spark, sf_dir).withColumn("funding_rate", F.when(F.col("symbol") == "click", F.col("close")).otherwise(0.0))
    return search.funded(c, b).select("candidate_id")
