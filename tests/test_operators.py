import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigmill.operators import indicators, inference, joins, ledger, panel, quality, regime, rules, search, signals, simulate
from sigmill.sources import bars as src


def walk(n=400, seed=7, symbol="A", step=300_000):
    r = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(r.normal(0, 0.004, n)))
    o = np.concatenate([[100.0], c[:-1]])
    hi, lo = np.maximum(o, c) * (1 + r.random(n) * 0.002), np.minimum(o, c) * (1 - r.random(n) * 0.002)
    v = r.lognormal(3, 1, n)
    return pd.DataFrame({"symbol": symbol, "open_time": np.arange(n) * step, "open": o, "high": hi, "low": lo, "close": c, "volume": v, "quote_volume": v * c})


def same(got, want, tol=1e-9):
    np.testing.assert_allclose(np.asarray(got, float), np.asarray(want, float), rtol=tol, atol=tol)


# ---- sources and quality ----


def test_normalise_and_partitioned_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([("open_time", *["x"] * 11), ("1700000000000000", "1", "2", "0.5", "1.5", "10", "1700000000999", "15", "3", "4", "6", "0"), ("1700000300000", "bad", "2", "1", "1", "1", "1", "1", "1", "1", "1", "0")], ", ".join(f"c{i} string" for i in range(12)))
    b = src.normalize_bars(raw).orderBy("open_time").collect()
    assert [r.open_time for r in b] == [1700000000000, 1700000300000]
    assert b[0].open == 1.0 and b[1].open is None and not b[0].data_quality_degraded and b[1].data_quality_degraded
    df = spark.createDataFrame(walk(50, step=86_400_000)).unionByName(spark.createDataFrame(walk(50, step=86_400_000)))
    src.write_bars(df, str(tmp_path / "s"), market="spot", dataset="klines", interval="1d")
    got = src.scan_bars(spark, str(tmp_path / "s"), market="spot", interval="1d", rows=10)
    assert got.count() == 10 and {"taker_buy_volume", "trade_count"} <= set(got.columns)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan or "dataset" in plan.split("PartitionFilters")[1][:200]
    assert src.extent(df.dropDuplicates()).first().rows == 50


def test_intervals_universe_months(spark):
    assert [src.interval_ms(x) for x in ("5m", "1h", "1d")] == [300_000, 3_600_000, 86_400_000]
    with pytest.raises(ValueError):
        src.interval_ms("5w")
    assert [r.symbol for r in src.universe(spark, symbols=[" btc ", "BTC", "eth"]).collect()] == ["BTC", "ETH"]
    assert src.universe(spark, "um_liquid_30").count() == 30
    with pytest.raises(ValueError):
        src.universe(spark, "none")
    assert [(r.year, r.month) for r in src.months(spark, "2023-11-15", "2024-01-02").collect()] == [(2023, 11), (2023, 12), (2024, 1)]


def test_quality(spark):
    p = walk(40)
    p.loc[3, "close"] = -1.0
    p.loc[5, "high"] = 0.0
    p = pd.concat([p.drop(index=20), p.iloc[[8]]])
    got = {(r.check_name): (r["count"], r.status) for r in quality.quality_checks(spark.createDataFrame(p), 300_000).collect()}
    assert got["duplicates"] == (1, "warn") and got["negative_values"] == (1, "fail") and got["ohlc_invariant"][1] == "fail" and got["gaps"] == (1, "warn") and got["zero_volume"] == (0, "pass")


def test_split_has_gaps_and_keeps_order(spark):
    s = quality.split_plan(spark.createDataFrame(walk(100)), gap=5).orderBy("open_time").toPandas().split
    assert list(s) == ["discovery"] * 55 + ["gap"] * 5 + ["validation"] * 15 + ["gap"] * 5 + ["holdout"] * 20
    s = quality.split_plan(spark.createDataFrame(walk(20)), gap=5).toPandas().split
    assert "gap" not in set(s)


# ---- joins ----


def test_as_of(spark):
    b = spark.createDataFrame([("A", t) for t in (0, 300, 900, 1200)], "symbol string, open_time long")
    e = spark.createDataFrame([("A", 300, 1.0), ("A", 600, 2.0), ("A", 650, 3.0), ("A", 900, None), ("A", 5000, 9.0), ("A", -5, 7.0), ("B", 0, 8.0)], "symbol string, calc_time long, r double")
    assert [x.r for x in joins.as_of(b, e, "r").orderBy("open_time").collect()] == [7.0, 1.0, 3.0, 3.0]
    f = joins.as_of_forward_sum(b, e, "r", name="f").orderBy("open_time").collect()
    assert [x.f for x in f] == [0.0, 1.0, 5.0, 0.0]
    assert [x.r for x in joins.exact(b, e, "r").orderBy("open_time").collect()] == [0.0, 1.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        joins.strict_zip(b.select("open_time"), b.where("open_time > 0").select("open_time"), "open_time").count()


# ---- indicators ----


def test_recursive_indicators_and_causality(spark):
    p = walk(300)
    df = spark.createDataFrame(p)
    got = indicators.features(df)[0].orderBy("open_time").toPandas()
    d = p.close.diff()
    rs = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean() / (-d).clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    same(got.rsi_14[30:], (100 - 100 / (1 + rs))[30:])
    same(got.ema_26, p.close.ewm(span=26, adjust=False).mean())
    assert len(indicators.features(src.with_defaults(df))[1]) == 74 and len(indicators.features(df)[1]) == 61
    cut = indicators.features(spark.createDataFrame(p.iloc[:200]))[0].orderBy("open_time").toPandas()
    for c in indicators.features(df)[1]:
        same(cut[c], got[c][:200])
    assert indicators.meaning("rsi_14")["family"] == "mean_reversion" and indicators.meaning("price_sma_ratio_20")["family"] == "hybrid"


# ---- simulator ----


def test_state_machines():
    s = np.array([0.1, 0.5, 0.2, 0.05, 0.2, -0.6, 0.4, 0.0])
    same(simulate.hysteresis(s, 0.5, 0.1), [0, 0.5, 0.2, 0, 0, -0.6, 0.4, 0])
    assert simulate.hysteresis(s, 0, 0) is s
    same(simulate.buffered(np.array([0.04, 0.2, 0.24, 0.3, -0.1]), 0.05), [0, 0.2, 0.2, 0.3, -0.1])
    one, r = np.ones(6), np.array([-0.02, -0.04, 0.01, 0.0, 0.0, 0.0])
    same(simulate.exits(one, r, simulate.Rules(stop_loss=-0.05)), [1, 1, 0, 0, 0, 0])
    same(simulate.exits(one, r, simulate.Rules(most_bars=2)), [1, 1, 0, 1, 1, 0])
    same(simulate.exits(one, np.array([0.03, 0.0, -0.05, 0, 0, 0]), simulate.Rules(tiers=((0.02, 0.5),))), [1, 0.5, 0.5, 0.5, 0.5, 0.5])
    same(simulate.exits(one, np.array([0.03, 0.0, -0.05, 0, 0, 0]), simulate.Rules(tiers=((0.02, 0.5),), trailing=0.02)), [1, 0.5, 0.5, 0, 0, 0])
    flip = np.array([1.0, 1, -1, -1, 1])
    same(simulate.exits(flip, np.array([-0.1, 0, 0, 0, 0]), simulate.Rules(stop_loss=-0.05)), [1, 0, -1, -1, 1])


def test_backtest_matches_pandas(spark):
    p = walk(300)
    s = np.clip(np.sin(np.arange(300) / 9), -1, 1)
    sig = spark.createDataFrame(pd.DataFrame({"candidate_id": "c", "symbol": "A", "open_time": p.open_time, "signal": s}))
    sizing = simulate.Sizing(interval="5m", window_days=1)
    got = simulate.backtest(sig, spark.createDataFrame(p), sizing=sizing).orderBy("open_time").toPandas()
    known = p.open.pct_change().shift(1)
    vol = known.rolling(288, min_periods=10).std() * math.sqrt(105_120)
    lev = (0.15 / vol.replace(0, np.nan)).clip(upper=3).fillna(0)
    pos = simulate.buffered((pd.Series(s).shift(1).fillna(0) * lev).to_numpy(), 0.05)
    turn = np.abs(np.diff(pos, prepend=0))
    cost = turn * (5 + 1 + 25 * np.sqrt(10_000 * turn / p.quote_volume)) / 10_000
    net = pos * (p.open.shift(-1) / p.open - 1).fillna(0) - cost
    same(got.position, pos)
    same(got.net_return, net)
    m = simulate.metrics(simulate.backtest(sig, spark.createDataFrame(p), sizing=sizing)).first()
    eq = (1 + net).cumprod()
    assert m.total_return == pytest.approx(eq.iloc[-1] - 1) and m.max_drawdown == pytest.approx((eq / eq.cummax() - 1).min())
    assert m.sharpe == pytest.approx(net.mean() / net.std() * math.sqrt(105_120))
    c = simulate.cost_summary(simulate.backtest(sig, spark.createDataFrame(p), sizing=sizing)).first()
    assert c.actual_cost_bps == pytest.approx(cost.sum() / turn.sum() * 1e4)
    curve = simulate.equity_curve(simulate.backtest(sig, spark.createDataFrame(p), sizing=sizing), points=50).orderBy("open_time").toPandas()
    assert 2 <= len(curve) <= 50 and curve.open_time.iloc[0] == 0 and curve.open_time.iloc[-1] == p.open_time.iloc[-1]


# ---- signals and regimes ----


def test_entry_only_filter_equals_the_loop(spark):
    r = np.random.default_rng(5)
    n = 200
    s = r.choice([-0.5, 0.0, 0.4, 0.7], n)
    ok = r.random(n) < 0.3
    p = pd.DataFrame({"symbol": "A", "open_time": range(n), "signal": s, "regime": np.where(ok, "bull", "bear")})
    want, prev = [], 0.0
    for v, a in zip(s, ok):
        prev = v if a or (prev and v and (v > 0) == (prev > 0)) else 0.0
        want.append(prev)
    got = signals.regime_filter(spark.createDataFrame(p), ["bull"], mode="entry_only").orderBy("open_time").toPandas()
    same(got.signal, want)


def test_smoothing_and_composite(spark):
    p = walk(60).assign(signal=np.sin(np.arange(60)))
    got = signals.smooth(spark.createDataFrame(p), "signal", 12).orderBy("open_time").toPandas()
    same(got.signal, p.signal.ewm(span=12, min_periods=1).mean())
    sig = spark.createDataFrame([("a", "A", 1, 1.0), ("b", "A", 1, -0.5)], "candidate_id string, symbol string, open_time long, signal double")
    w = spark.createDataFrame([("m", "a", 3.0), ("m", "b", 1.0), ("one", "a", 1.0)], "composite_id string, candidate_id string, weight double")
    assert {r.candidate_id: r.signal for r in signals.composite(sig, w).collect()} == {"m": pytest.approx(2.5 / 4), "one": 0.0}


def test_regimes(spark):
    p = walk(300)
    got = regime.rolling_labels(spark.createDataFrame(p), window=48).orderBy("open_time").toPandas()
    ret, vol = p.close.pct_change(48), p.close.pct_change().rolling(48, min_periods=10).std()
    rank = vol.expanding(min_periods=10).rank(pct=True)
    want = np.select([ret > 0.2, ret < -0.2, rank > 0.85], ["bull", "bear", "high_vol"], "sideways")
    assert list(got.regime) == list(want)
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(-2, 0.5, (300, 2)), r.normal(2, 0.5, (300, 2))])
    m = regime.MarkovModel(2).fit(np.concatenate([x, x]))
    path = m.decode(x)
    assert len(set(path[:290])) == 1 and len(set(path[310:])) == 1 and path[0] != path[-1]
    f = m.filtered(x)
    same(f[:200], m.filtered(x[:200]))
    same(f.sum(1), np.ones(600))
    same(m.stationary() @ m.move, m.stationary())


# ---- panel and inference ----


def test_weights(spark):
    d = pd.DataFrame({"open_time": 1, "symbol": list("abcde"), "factor": [3.0, 1.0, None, 2.0, 5.0], "fwd_ret": [0.1, -0.1, 0.2, 0.0, 0.3]})
    d["in_universe"] = d.factor.notna()
    df = spark.createDataFrame(d).withColumn("factor", F.when(F.isnan("factor"), None).otherwise(F.col("factor")))
    w = {r.symbol: r.weight for r in panel.rank_weights(df).collect()}
    assert sum(w.values()) == pytest.approx(0) and sum(map(abs, w.values())) == pytest.approx(1) and w["c"] == 0 and w["e"] == max(w.values())
    q = {r.symbol: r.weight for r in panel.quantile_weights(df, 0.25).collect()}
    assert q == {"a": 0, "b": -0.5, "c": 0, "d": 0, "e": 0.5}
    assert panel.ic(df).first().ic == pytest.approx(1.0)


def test_hold_zeroes_a_name_until_the_next_rebalance(spark):
    rows = [(t, "a", 1.0, t != 1) for t in range(6)]
    df = spark.createDataFrame([(t, s, w, i) for t, s, w, i in rows], "open_time long, symbol string, weight double, in_universe boolean")
    assert [r.weight for r in panel.hold(df, 3).orderBy("open_time").collect()] == [1, 0, 0, 1, 1, 1]


def test_inference(spark):
    r = np.random.default_rng(2)
    x = r.normal(0.1, 1, 500)
    df = spark.createDataFrame(pd.DataFrame({"candidate_id": "c", "open_time": range(500), "x": x}))
    assert inference.newey_west(df, "x").first().tstat == pytest.approx(inference.nw_t(x))
    m = df.groupBy("candidate_id").agg(*inference.moments(F.col("x"))).first()
    z = (x - x.mean()) / x.std(ddof=1)
    assert (m.skew, m.kurtosis) == (pytest.approx((z**3).mean()), pytest.approx((z**4).mean()))
    ci = inference.bootstrap_sharpe(df, "x", year=1.0, resamples=300, block=5).first()
    s = x.mean() / x.std(ddof=1)
    assert ci.ci_low < s < ci.ci_high
    assert inference.normal_cdf(inference.inverse_normal_cdf(0.975)) == pytest.approx(0.975)
    got = spark.range(-40, 41).select(inference.cdf(F.col("id") / 10.0).alias("p"), (F.col("id") / 10.0).alias("x")).toPandas()
    same(got.p, [inference.normal_cdf(v) for v in got.x], 2e-7)
    assert len(inference.cscv_splits(8)) == 35 and inference.cscv_splits(3) == []
    assert inference.expected_max_sharpe(400, 1.0) > inference.expected_max_sharpe(10, 1.0) > 0 == inference.expected_max_sharpe(1, 1.0)


def test_romano_wolf_finds_the_real_one(spark):
    r = np.random.default_rng(3)
    rows = [("f", k, t, float(r.normal(0.4 if k == "good" else 0.0, 1))) for k in ("good", "n1", "n2", "n3") for t in range(300)]
    df = spark.createDataFrame(rows, "family string, factor_id string, open_time long, net_return double")
    p = {x.factor_id: x.fwer_p for x in inference.romano_wolf(df, resamples=300).collect()}
    assert p["good"] < 0.05 < min(p["n1"], p["n2"], p["n3"])


def test_pbo_of_noise_and_of_one(spark):
    r = np.random.default_rng(4)
    rows = [(f"c{k}", t, float(r.normal(0.3 if k == 0 else 0.0, 1))) for k in range(6) for t in range(400)]
    df = spark.createDataFrame(rows, "candidate_id string, open_time long, net_return double")
    assert {x.candidate_id: x.pbo for x in inference.pbo(df).collect()}["c0"] == 0.0
    assert [x.pbo for x in inference.pbo(df.where("candidate_id = 'c0'")).collect()] == [1.0]


# ---- rules, search, ledger ----

GOOD = dict(deflated_sharpe_prob=0.99, pbo=0.1, fdr_p=0.01, ic_tstat=3.0, rankic_tstat=3.0, ci_low=0.2, oos_trades=200, break_even_bps=20.0, actual_cost_bps=6.0, prior_posterior_ratio=1.0, capacity_usd=2e4, leakage_passed=True, schedulable=True, max_abs_ic=0.02, max_abs_rankic=0.02, turnover_adjusted_return=0.1, decay_quality=0.5, max_abs_spread=2.0, gross_sharpe=2.0, net_sharpe=1.0, deflated_sharpe=2.0)


def row(spark, **change):
    d = GOOD | change
    return spark.createDataFrame([(1, *d.values())], ["experiment_id", *d])


@pytest.mark.parametrize("change,tier", [({}, "full_pass"), ({"pbo": 0.5}, "fail"), ({"max_abs_ic": 0.0, "max_abs_rankic": 0.0}, "conditional_pass"), ({"degraded_ratio": 0.15}, "full_pass"), ({"degraded_ratio": 0.25}, "fail"), ({"regime_conflict": True}, "conditional_pass"), ({"break_even_bps": 11.0}, "fail"), ({"ic_tstat": 0.0}, "full_pass")])
def test_tiers(spark, change, tier):
    s = rules.stratify(row(spark, **change))
    assert s.first().risk_tier == tier
    assert (rules.hard_score(s).first().score > 0) == (tier != "fail")


def test_near_miss_order(spark):
    why = lambda **c: rules.near_miss(rules.research_gate(rules.stratify(row(spark, **c)))).first()
    assert why().primary_reason == "production_passed"
    assert why(pbo=0.5, net_sharpe=-1.0).primary_reason == "cost_destroyed_edge"
    assert why(pbo=0.5, gross_sharpe=0.1, turnover=0.3).reasons == ["excess_turnover", "overfit_or_unstable"]
    assert not why(capacity_usd=1.0, gross_sharpe=0.1, net_sharpe=0.0, max_abs_ic=0.0, max_abs_rankic=0.0, max_abs_spread=0.0, break_even_bps=13.0).reasons == []


def test_search(spark):
    p = spark.createDataFrame([("p",), ("q",)], "parent_id string")
    g = search.grid(p, {"a": [1, 2, 3], "b": [10, 20]}, per_parent=4, total=6, score=F.col("a") * F.col("b"))
    assert g.count() == 6 and g.groupBy("parent_id").count().agg(F.max("count")).first()[0] <= 4
    assert search.allocate_budget(20, {"exploit": 10, "variation": 0, "targeted_repair": 2}) == {"exploit": 10, "variation": 0, "targeted_repair": 2, "seed": 2}
    kids = search.crossover([{"candidate_id": "1", "family": "a", "expression": "TS_MEAN($close, 5)"}, {"candidate_id": "2", "family": "b", "expression": "$volume"}, {"candidate_id": "3", "family": "a", "expression": "$open"}], set())
    assert {tuple(k["parents"]) for k in kids} == {("1", "2"), ("2", "3")} and len(kids) == 4
    assert search.freeze_point("TS_MEAN($close + $open, 5) * 2", 1) == "$close * 2"
    x = spark.createDataFrame([(-0.5, 5, 0.5), (0.1, 0, 0.0)], "stop_loss_pct double, max_hold_bars int, trailing_stop_pct double")
    assert [tuple(r) for r in search.clamp_exits(x).collect()] == [(-0.15, 10, 0.10), (0.0, 0, 0.0)]


def test_ledger(spark, tmp_path):
    t = spark.createDataFrame([("1", " Trend ", "a", None), ("1", "trend", "a", None), ("2", "trend", "b", "a")], "trial_id string, family string, candidate_id string, lineage_id string")
    new = ledger.record_trials(spark.createDataFrame([("2",)], "trial_id string"), t).collect()
    assert [(r.trial_id, r.family, r.lineage_id) for r in new] == [("1", "trend", "a")]
    old = spark.createDataFrame([("c", "active", 5)], "candidate_id string, status string, paper_trade_start long")
    up = ledger.upsert_survivors(old, spark.createDataFrame([("c", "promoted", 9), ("d", "active", 7)], "candidate_id string, status string, paper_trade_start long"))
    assert sorted(tuple(r) for r in up.collect()) == [("c", "promoted", 5), ("d", "active", 7)]
    ledger.write_bundle(spark, old, str(tmp_path / "b"))
    assert ledger.verify_bundle(spark, str(tmp_path / "b")).first().valid
    m = ledger.migrate_lineage(spark.createDataFrame([("old_x_1",), ("new",)], "lineage_id string"), ["old_*_1"])
    assert sorted(r[0] for r in m.collect()) == ["legacy", "new"]
    tr = spark.createDataFrame([("SEED", "promoted" if i < 5 else "no") for i in range(40)] + [("CROSSOVER", "promoted" if i < 20 else "no") for i in range(40)], "operator string, outcome string")
    u = ledger.uplift(tr).first()
    assert u.operator == "CROSSOVER" and u.uplift == pytest.approx(0.375) and u.low > 0


def test_hash_of_repeated_rows(spark):
    """Order doesn't matter, repeats do: two equal rows are not like none."""

    h = lambda rows: spark.createDataFrame(rows, "a long, b string").agg(src.frame_hash(spark.createDataFrame([], "a long, b string")).alias("h")).first().h
    assert h([(1, "x"), (2, None)]) == h([(2, None), (1, "x")])
    assert len({h([(1, "x")]), h([(1, "x")] * 2), h([(1, "x")] * 3), h([(1, "x"), (2, "y"), (2, "y")])}) == 4


def test_signal_kinds(spark):
    """Any other kind is the deviation from VWAP, uncentred; funding that is zero throughout fails."""
    r = np.random.default_rng(3)
    n, back = 60, 5
    close, volume = 100 + r.normal(size=n).cumsum(), r.integers(1, 9, n).astype(float)
    df = spark.createDataFrame([("a", i, float(close[i]), float(volume[i]), 0.0) for i in range(n)], "symbol string, open_time long, close double, volume double, funding_zscore double")
    got = [x.signal for x in signals.factor_signal(df, "breakout", back).orderBy("open_time").collect()]
    d = np.zeros(n)
    for i in range(back - 1, n):
        w = slice(i - back + 1, i + 1)
        d[i] = close[i] / ((close[w] * volume[w]).sum() / volume[w].sum()) - 1
    want = [0.0] * n
    for i in range(back - 1, n):
        s = d[max(0, i - 4 * back + 1) : i + 1].std(ddof=1)
        want[i] = -np.tanh(d[i] / s / 2) if s > 0 else 0.0
    assert np.allclose(got, want, atol=1e-9)
    with pytest.raises(Exception, match="zero throughout"):
        signals.factor_signal(df, "funding_basis", back).collect()


def test_turnover_repair_saturates(spark):
    rows = [(1, 24, 0.2, 0.15, 0.3), (2, 96, 0.4, 0.3, 0.3), (3, 96, 0.4, 0.3, 0.01)]
    df = spark.createDataFrame([(*x, False, "rejected", "") for x in rows], "experiment_id long, smooth_span long, signal_threshold double, position_buffer double, turnover double, passed boolean, research_status string, blocking_failures string")
    got = {x.experiment_id: x.reasons for x in rules.near_miss(rules.with_needs(df)).collect()}
    assert "excess_turnover" in got[1] and "turnover_repair_saturated" not in got[1] and "turnover_repair_saturated" in got[2] and "excess_turnover" not in got[3]


def test_planted_regimes(spark):
    r = np.random.default_rng(1)
    rows = [("a", i, float(r.normal()), "up" if i % 2 else "down") for i in range(4000)]
    df = spark.createDataFrame(rows, "symbol string, open_time long, ret double, regime string")
    got = inference.plant_regime(df, "ret", "regime", ["up"], 0.8, keys=("symbol",)).toPandas()
    corr = got.groupby("regime")[["signal", "ret"]].apply(lambda g: g.signal.corr(g.ret))
    assert corr["up"] > 0.7 and abs(corr["down"]) < 0.08


def test_candidates_of_few_families_are_made_in_many_tasks(spark):
    """Three families, each table in one partition: rows are spread, and are those of a plain product."""
    h = spark.createDataFrame([(f"h{i}", f"f{i % 3}") for i in range(400)], "hypothesis_id string, family string").coalesce(1)
    i = spark.createDataFrame([(f"f{k % 3}", f"i{k}") for k in range(9)], "family string, indicator string").coalesce(1)
    s = spark.createDataFrame([("a",), ("b",)], "symbol string").coalesce(1)
    got = search.cross_candidates(h, s, i).withColumn("task", F.spark_partition_id()).collect()
    want = {(f"h{a}", x, f"i{b}", v) for a in range(400) for b in range(9) if a % 3 == b % 3 for x in "ab" for v in ("base", "inverse", "low_turnover")}
    assert len(got) == len(want) and {(x.hypothesis_id, x.symbol, x.indicator, x.variant) for x in got} == want
    tasks = [x.task for x in got]
    assert len(set(tasks)) >= 12 and max(tasks.count(k) for k in set(tasks)) <= len(got) / 5


def test_candidates_hold_each_indicator_once(spark):
    """What goes to executors or through a shuffle is as many rows as the tables have, whatever the number of tasks."""
    h = spark.createDataFrame([(f"h{i}", f"f{i % 3}") for i in range(60)], "hypothesis_id string, family string")
    i = spark.createDataFrame([(f"f{k % 3}", f"i{k}") for k in range(90)], "family string, indicator string")
    s = spark.createDataFrame([("a",), ("b",)], "symbol string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for most in (kept["spark.sql.autoBroadcastJoinThreshold"], "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            df = search.cross_candidates(h, s, i)
            assert len(df.collect()) == 60 * 30 * 2 * 3
            moved, nodes = 0, [df._jdf.queryExecution().executedPlan()]
            while nodes:
                x = nodes.pop()
                nodes += [x.children().apply(k) for k in range(x.children().size())]
                if "Exchange" in x.nodeName():
                    rows = x.metrics().get("numOutputRows" if "Broadcast" in x.nodeName() else "shuffleRecordsWritten")
                    moved += rows.get().value()
            assert 0 < moved <= 60 + 90 + 2
    finally:
        for k, x in kept.items():
            spark.conf.set(k, x)
