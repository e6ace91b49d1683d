"""Gates, tiers, research gate, near misses and scores over one row per experiment.

Result rows carry the columns named in NEEDS (missing ones count as NULL);
everything is one select of expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.functions import frames as fr

from .inference import combined_p

NEEDS = {
    "deflated_sharpe_prob": "double", "pbo": "double", "is_ml": "boolean", "fdr_p": "double", "ic_tstat": "double", "rankic_tstat": "double", "ci_low": "double",
    "oos_trades": "long", "break_even_bps": "double", "actual_cost_bps": "double", "prior_posterior_ratio": "double", "capacity_usd": "double", "regime_share": "double",
    "leakage_passed": "boolean", "split_overlap": "boolean", "autocorr1": "double", "degraded_ratio": "double", "schedulable": "boolean", "deflated_sharpe": "double",
    "regime_diversity": "double", "max_abs_ic": "double", "max_abs_rankic": "double", "max_abs_spread": "double", "ic_ci_excludes_zero": "boolean",
    "turnover_adjusted_return": "double", "decay_quality": "double", "long_short_spread_sharpe": "double", "regime_conflict": "boolean", "max_abs_regime_ic": "double",
    "max_abs_funding_ic": "double", "gross_sharpe": "double", "net_sharpe": "double", "long_sharpe": "double", "short_sharpe": "double", "turnover": "double",
    "best_horizon": "long", "lookback": "long", "smooth_span": "long", "signal_threshold": "double", "position_buffer": "double", "best_regime": "string", "best_funding_key": "string",
}
# Rules that block, and thresholds.
BLOCKING = ("G1", "G2", "G5", "G8", "G10", "G11", "G14", "G15")
LOW_TURNOVER_STEPS = ((24, 0.20, 0.15), (48, 0.30, 0.25), (96, 0.40, 0.30))  # smooth_span, signal_threshold, position_buffer


def with_needs(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in NEEDS.items() if c not in df.columns})


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _or(c: str, default: float) -> Column:
    return F.coalesce(F.col(c), F.lit(float(default)))


def gate_items(df: DataFrame) -> list[tuple[str, Column, Column, float | None]]:
    """(rule, passes, value, threshold) of every gate but G14 and G16, in order."""
    c = F.col
    actual = F.greatest(_or("actual_cost_bps", 0), F.lit(1e-12))
    fdr = F.coalesce("fdr_p", combined_p(c("ic_tstat"), c("rankic_tstat")))  # alone, without a family: the raw p
    return [
        ("G1", _or("deflated_sharpe_prob", 0) >= 0.95, _or("deflated_sharpe_prob", 0), 0.95),
        ("G3", fdr <= 0.05, fdr, 0.05),
        ("G4", _yes(c("ic_tstat") > 2.0), c("ic_tstat"), 2.0),
        ("G4R", _yes(c("rankic_tstat") > 2.0), c("rankic_tstat"), 2.0),
        ("G5", _yes(c("ci_low") > 0), c("ci_low"), 0.0),
        ("G2", _or("pbo", 1) < F.when(_yes(c("is_ml")), 0.30).otherwise(0.40), _or("pbo", 1), 0.40),
        ("G7", _or("oos_trades", 0) >= 100, _or("oos_trades", 0), 100.0),
        ("G8", _yes(c("break_even_bps") > 2.0 * actual), c("break_even_bps"), None),
        ("G9", _yes(c("prior_posterior_ratio") < 5.0), c("prior_posterior_ratio"), 5.0),
        ("G10", _yes(c("capacity_usd") >= 10_000), c("capacity_usd"), 10_000.0),
        ("G11", _yes(c("leakage_passed")) & ~_yes(c("split_overlap")), F.lit(None).cast("double"), None),
        ("G6", _or("regime_share", 0) <= 0.80, _or("regime_share", 0), 0.80),
        ("G13", F.abs(_or("autocorr1", 0)) <= 0.10, F.abs(_or("autocorr1", 0)), 0.10),
        ("G15", _yes(c("schedulable")), F.lit(None).cast("double"), None),
    ]


def gates(df: DataFrame, key: str = "experiment_id") -> DataFrame:
    """Long: key, rule_id, status (pass, warn, fail), value, threshold."""
    df = with_needs(df)
    item = lambda rule, status, value, threshold: F.struct(F.lit(rule).alias("rule_id"), status.alias("status"), value.cast("double").alias("value"), F.lit(threshold).cast("double").alias("threshold"))
    rows = [item(r, F.when(ok, "pass").otherwise("fail" if r in BLOCKING else "warn"), v, t) for r, ok, v, t in gate_items(df)]
    bad = _or("degraded_ratio", 0)
    g14 = item("G14", F.when(bad <= 0.10, "pass").when(bad <= 0.20, "warn").otherwise("fail"), bad, 0.10)
    rows.insert(len(rows) - 1, g14)
    return df.select(key, F.inline(F.array(*rows)))


def raw_pass(items: DataFrame, key: str = "experiment_id") -> DataFrame:
    failed = (F.col("status") == "fail") & F.col("rule_id").isin(*BLOCKING)
    fails = F.array_sort(F.collect_list(F.when(failed, F.col("rule_id"))))
    return items.groupBy(key).agg((F.count_if(failed) == 0).alias("raw_passed"), F.array_join(fails, ",").alias("blocking_failures"), F.count_if(F.col("status") == "warn").alias("warnings"))


def evidence_dimensions() -> Column:
    c = F.col
    ic = _or("max_abs_ic", 0)
    parts = [
        _yes(c("ic_ci_excludes_zero")) | (ic >= 0.01),
        _or("max_abs_rankic", 0) >= 0.01,
        _or("turnover_adjusted_return", 0) > 0,
        _or("decay_quality", 0) >= 0.25,
        F.abs(_or("long_short_spread_sharpe", 0)) >= 0.4,
        _or("max_abs_spread", 0) >= 1.0,
    ]
    return sum((p.cast("int") for p in parts), F.lit(0))


def evidence_level() -> Column:
    """strong, moderate or weak; one lower if regimes conflict."""
    n, ic = F.col("dimensions"), _or("max_abs_ic", 0)
    some = (ic >= 0.01) | (_or("max_abs_rankic", 0) >= 0.01) | (_or("max_abs_spread", 0) >= 1.0)
    rank = F.when((n >= 4) & (ic >= 0.01), 2).when((n >= 2) & some, 1).otherwise(0)
    rank = F.greatest(F.lit(0), rank - _yes(F.col("regime_conflict")).cast("int"))
    return F.element_at(F.array(F.lit("weak"), F.lit("moderate"), F.lit("strong")), rank + 1)


def stratify(df: DataFrame, key: str = "experiment_id") -> DataFrame:
    """Result rows with blocking_failures, evidence level, risk tier, allocation and review days."""
    d = with_needs(df).join(raw_pass(gates(df, key), key), key)
    d = d.withColumn("dimensions", evidence_dimensions()).withColumn("evidence_level", evidence_level())
    fails = ~F.col("raw_passed") | (F.col("evidence_level") == "weak")
    tier = F.when(fails, "fail").when(F.col("evidence_level") == "strong", "full_pass").otherwise("conditional_pass")
    d = d.withColumn("risk_tier", tier)
    t = F.col("risk_tier")
    return d.withColumns(
        {
            "passed": t != "fail",
            "allocation": F.when(t == "fail", 0.0).when(t == "full_pass", 1.0).otherwise(0.25),
            "review_after_days": F.when(t == "conditional_pass", 60),
            "g16": F.when(t == "full_pass", "pass").when(t == "conditional_pass", "warn").otherwise("fail"),
        }
    )


def cost_margin() -> Column:
    return _or("break_even_bps", 0) - 2.0 * _or("actual_cost_bps", 0)


def underpowered() -> Column:
    """Promising but short of data: FDR and trades not passed, yet likely positive after costs."""
    return (_or("fdr_p", 1) > 0.05) & (_or("oos_trades", 0) < 100) & (_or("deflated_sharpe_prob", 0) >= 0.5) & (_or("net_sharpe", 0) > 0) & (cost_margin() > 0)


def research_gate(tiers: DataFrame) -> DataFrame:
    """Add research_score and research_status (production_passed, research_survivor, rejected); input of ``stratify``."""
    terms = [
        (F.col("passed"), 10.0), (F.col("passed") & (F.col("risk_tier") == "conditional_pass"), 5.0),
        (_or("max_abs_ic", 0) >= 0.01, 1.0), (_or("max_abs_rankic", 0) >= 0.01, 1.0), (_or("max_abs_spread", 0) >= 1.0, 1.0),
        (_or("max_abs_regime_ic", 0) >= 0.015, 1.5), (_or("max_abs_funding_ic", 0) >= 0.015, 1.5), (_or("gross_sharpe", 0) >= 0.5, 1.0),
        (_or("net_sharpe", 0) > 0, 0.5), (F.greatest(_or("long_sharpe", 0), _or("short_sharpe", 0)) >= 0.4, 1.0), (cost_margin() > 0, 0.5), (underpowered(), 1.0),
    ]
    score = sum((F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for c, w in terms), F.lit(0.0))
    status = F.when(F.col("passed"), "production_passed").when(score >= 1.5, "research_survivor").otherwise("rejected")
    return tiers.withColumns({"research_score": score, "research_status": status})


def survivors(gated: DataFrame, key: str = "experiment_id") -> DataFrame:
    """Rows to keep watching, with what they still need."""
    s = gated.where("research_status = 'research_survivor'")
    return s.select(key, "research_score", F.greatest(F.lit(0), 100 - _or("oos_trades", 0)).cast("long").alias("required_trades"), F.lit(90).alias("required_oos_days"))


def hard_score(tiers: DataFrame) -> DataFrame:
    """Add score, 0 to 100, times allocation; 0 if failed."""
    unit = lambda x: F.coalesce(fr.clip(x, 0, 1), F.lit(0.0))
    soft = lambda x, s: fr.tanh(F.greatest(F.lit(0.0), x) / s)
    ratio = F.col("prior_posterior_ratio")
    raw = (
        25 * soft(_or("deflated_sharpe", 0), 2.0)
        + 20 * unit(1 - _or("pbo", 1))
        + 15 * soft(F.greatest(_or("ic_tstat", 0), _or("rankic_tstat", 0)), 4.0)
        + 10 * unit(1 - _or("fdr_p", 1) / 0.05)
        + 10 * F.sqrt(unit(_or("oos_trades", 0) / 100))
        + 8 * unit(_or("regime_diversity", 0))
        + 7 * F.coalesce(F.when(ratio > 0, unit(1 - F.abs(F.ln(ratio)) / math.log(5))), F.lit(0.0))
        + 5 * unit(1 - F.abs(_or("autocorr1", 0)) / 0.2)
    )
    return tiers.withColumn("score", F.round(F.when(F.col("passed"), F.round(raw, 4)).otherwise(F.lit(0.0)) * F.col("allocation"), 4))


def regime_spread(per_regime: DataFrame, key: str = "experiment_id") -> DataFrame:
    """regime_share and regime_diversity from (key, regime, trade_count, pnl); regimes under 5 % of trades don't count."""
    total = F.sum("trade_count").over(fr.whole((key,)))
    p = per_regime.withColumn("_total", total)
    p = p.withColumn("_gain", F.when(F.col("trade_count") / F.greatest(F.col("_total"), F.lit(1)) >= 0.05, F.greatest(F.lit(0.0), F.col("pnl"))))
    g = p.groupBy(key).agg(F.max("_total").alias("t"), F.max("_gain").alias("m"), F.sum("_gain").alias("s"), F.count("_gain").alias("n"))
    share = F.when((F.col("t") == 0) | (F.col("n") == 0), 0.0).when(F.col("s") <= 0, 1.0).otherwise(fr.divide(F.col("m"), F.when(F.col("s") > 0, F.col("s"))))
    even = fr.divide(1 - fr.divide(F.col("m"), F.when(F.col("s") > 0, F.col("s"))), 1 - fr.divide(F.lit(1.0), F.when(F.col("n") > 1, F.col("n"))))
    return g.select(key, share.alias("regime_share"), F.when(F.col("t") == 0, 0.0).otherwise(F.coalesce(fr.clip(even, 0, 1), F.lit(0.0))).alias("regime_diversity"))


def near_miss(gated: DataFrame, key: str = "experiment_id") -> DataFrame:
    """key, primary_reason, reasons (array, in order of weight), actionable; input of ``research_gate``."""
    c = F.col
    drag = c("gross_sharpe") - _or("net_sharpe", 0)
    edge = lambda name: _or(name, 0) >= F.greatest(F.lit(0.015), 1.5 * F.greatest(_or("max_abs_ic", 0), F.lit(0.005)))
    best = F.greatest(_or("long_sharpe", 0), _or("short_sharpe", 0))
    weak = underpowered()
    costly = _yes(c("gross_sharpe") >= 0.5) & ((_or("net_sharpe", 0) <= 0) | _yes(drag >= 0.75) | (cost_margin() < 0))
    # how many of the calming steps the candidate has taken; the next one, or the second for a high turnover
    taken = sum(((_or("smooth_span", 1) >= span) & (_or("signal_threshold", 0) >= level) & (_or("position_buffer", 0) >= room)).cast("int") for span, level, room in LOW_TURNOVER_STEPS)
    saturated = F.greatest(taken, F.when(_or("turnover", 0) >= 0.20, 1).otherwise(0)) >= len(LOW_TURNOVER_STEPS)
    tests = [
        ("statistically_underpowered_survivor", weak),
        ("cost_destroyed_edge", costly),
        ("turnover_repair_saturated", costly & saturated),
        ("excess_turnover", _or("turnover", 0) >= 0.15),
        ("turnover_repair_saturated", (_or("turnover", 0) >= 0.15) & saturated),
        ("horizon_mismatch", _yes(c("best_horizon") != c("lookback")) & (_or("max_abs_ic", 0) >= 0.01)),
        ("regime_mixing", c("best_regime").isNotNull() & edge("max_abs_regime_ic")),
        ("funding_state_mixing", c("best_funding_key").isNotNull() & edge("max_abs_funding_ic")),
        ("long_short_asymmetry", (best >= 0.4) & (best - _or("net_sharpe", 0) >= 0.5)),
        ("insufficient_trades", ~weak & (_or("oos_trades", 0) < 100)),
        ("overfit_or_unstable", F.array_contains(F.split("blocking_failures", ","), "G2") | F.array_contains(F.split("blocking_failures", ","), "G5")),
    ]
    found = F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests]))
    other = F.when(c("research_status") == "research_survivor", F.array(F.lit("weak_but_stable_ic"))).otherwise(F.array(F.lit("no_evidence")))
    d = gated.withColumn("reasons", F.when(c("passed"), F.array(F.lit("production_gate_passed"))).when(F.size(found) > 0, found).otherwise(other))
    first = F.when(c("passed"), "production_passed").otherwise(F.element_at("reasons", 1))
    return d.select(key, first.alias("primary_reason"), "reasons", (~c("passed") & (F.element_at("reasons", 1) != "no_evidence")).alias("actionable"))


def repairs(misses: DataFrame, key: str = "experiment_id") -> DataFrame:
    """One row a reason that suggests a change: key, action."""
    # What to try for each reason.
    action = {
        "statistically_underpowered_survivor": "accumulate_oos_evidence", "cost_destroyed_edge": "reduce_turnover", "excess_turnover": "reduce_turnover",
        "horizon_mismatch": "use_best_horizon", "regime_mixing": "add_regime_filter", "funding_state_mixing": "add_funding_filter",
        "long_short_asymmetry": "split_long_short", "insufficient_trades": "broaden_entries", "overfit_or_unstable": "simplify_signal", "weak_but_stable_ic": "use_as_filter",
    }
    table = F.create_map(*[F.lit(x) for pair in action.items() for x in pair])
    return misses.where("actionable").select(key, F.explode("reasons").alias("reason")).select(key, "reason", F.element_at(table, F.col("reason")).alias("action")).where("action is not null")


def lifecycle(store: DataFrame, checked: DataFrame, *, most_failures: int = 3, days: int = 90, trades: int = 100, fdr: float = 0.10) -> DataFrame:
    """New survivor snapshot from the old one and rechecks.

    store: candidate_id, status, failures, elapsed_days; checked: candidate_id,
    research_status, oos_trades, fdr_p, cost_margin_bps, net_sharpe.
    """
    d = store.join(checked, "candidate_id", "left")
    live = (F.col("status") == "active") & F.col("research_status").isNotNull()
    won = (F.col("research_status") == "production_passed") | ((F.col("fdr_p") < fdr) & (F.col("oos_trades") >= trades) & (F.col("elapsed_days") >= days) & (F.col("cost_margin_bps") > 0) & (F.col("net_sharpe") > 0))
    lost = F.col("research_status") == "rejected"
    count = F.when(~live, F.col("failures")).when(lost, F.col("failures") + 1).otherwise(F.lit(0))
    status = F.when(live & _yes(won), "promoted").when(live & lost & ((F.col("oos_trades") >= trades) | (F.col("failures") + 1 >= most_failures)), "retired").otherwise(F.col("status"))
    return d.select("candidate_id", status.alias("status"), count.cast("int").alias("failures"), "elapsed_days")


def diagnostics(items: DataFrame) -> DataFrame:
    """Failures and warnings by rule."""
    return items.groupBy("rule_id").agg(F.count_if(F.col("status") == "fail").alias("fails"), F.count_if(F.col("status") == "warn").alias("warns"), F.count(F.lit(1)).alias("rows"))
