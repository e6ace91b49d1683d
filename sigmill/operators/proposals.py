"""What to try next: composites of the best factors, and changed parameters for survivors.

A factor is a row with its results and parameters (NEEDS; what is missing is
NULL). A proposal is a row with its parent, kind and variant, and the changed
parameters; a NULL parameter stays as it is. Tables of factors may be large:
the best are taken by one ordered limit, and the rest works on those few or
row by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmill.functions.scratch import durable

from .search import diverse, evidence_weights, outcome

NEEDS = {
    "candidate_id": "string", "family": "string", "passed": "boolean", "research_status": "string", "research_score": "double", "gross_sharpe": "double", "net_sharpe": "double",
    "cost_margin_bps": "double", "turnover": "double", "ic_tstat": "double", "rankic_tstat": "double", "permutation_p": "double", "cost_drag": "double", "max_drawdown": "double",
    "avg_holding": "double", "trade_count": "long", "smooth_span": "long", "signal_threshold": "double", "position_buffer": "double", "lookback": "long", "zscore_window": "long",
    "tanh_scale": "double", "regime_filter": "string", "best_regime": "string", "best_regime_sharpe": "double",
}
CHANGES = {
    "smooth_span": "long", "signal_threshold": "double", "position_buffer": "double", "lookback": "long", "zscore_window": "long", "tanh_scale": "double", "regime_filter": "string",
    "stop_loss_pct": "double", "trailing_stop_pct": "double", "max_hold_bars": "int", "tp_tier_pct": "double", "tp_tier_fraction": "double", "trailing_after_first_tp": "boolean",
}
# Lookbacks and their like, calming steps, weights of pairs.
LOOKBACKS, ZSCORE_WINDOWS, TANH_SCALES = (6, 12, 24, 48, 96), (96, 288, 576), (1.0, 2.0, 3.0)
CALM_STEPS = ((12, 0.10, 0.08), (24, 0.20, 0.15), (48, 0.30, 0.25), (96, 0.40, 0.30))
PAIR_WEIGHTS = (0.20, 0.40, 0.60, 0.80)


def _factors(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in NEEDS.items() if c not in df.columns})


def _or(name: str, other: float) -> Column:
    return F.coalesce(F.col(name), F.lit(float(other)))


def _strength() -> Column:
    return F.greatest(F.abs(_or("ic_tstat", 0)), F.abs(_or("rankic_tstat", 0)))


def has_evidence() -> Column:
    """Worth another look: passed, or any single strong sign."""
    signs = [F.col("passed"), F.col("research_score") >= 1.5, F.col("gross_sharpe") >= 0.5, _strength() >= 1.5, F.col("permutation_p").between(1e-300, 0.20), (F.col("cost_margin_bps") > 0) & (F.col("net_sharpe") > 0)]
    return F.coalesce(F.array_max(F.array(*[F.coalesce(s, F.lit(False)) for s in signs])), F.lit(False))


def by_merit() -> list[Column]:
    """Best first: passed, research score, gross Sharpe, cost margin, low turnover; ties by id."""
    zero_is_none = lambda c: F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.lit(-999.0))
    first = [F.coalesce(F.col("passed"), F.lit(False)).cast("int"), zero_is_none("research_score"), _or("gross_sharpe", -999), zero_is_none("cost_margin_bps"), -_or("turnover", 999)]
    return [*[c.desc() for c in first], F.col("candidate_id")]


def survivors(factors: DataFrame, limit: int = 8) -> DataFrame:
    return _factors(factors).where(has_evidence()).orderBy(*by_merit()).limit(limit)


def composite_pool(factors: DataFrame, limit: int = 24, selected: int = 8) -> DataFrame:
    """The ``selected`` best that passed (or, if none did, the best with evidence) and then others with evidence; adds place, from 1."""
    f = _factors(factors)
    ok = has_evidence() | F.coalesce(F.col("research_status").isin("production_passed", "research_survivor"), F.lit(False))
    best = f.where(ok).orderBy(*by_merit()).limit(limit)  # what passed is first in this order
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by_merit()))  # of at most ``limit`` rows
    any_passed = F.max(F.coalesce(F.col("passed"), F.lit(False)).cast("int")).over(Window.partitionBy(F.lit(0))) == 1
    chosen = (F.col("place") <= selected) & (F.coalesce(F.col("passed"), F.lit(False)) | ~any_passed)
    return best.withColumn("place", place).withColumn("selected", chosen)


def composites(factors: DataFrame, most: int = 12) -> DataFrame:
    """composite_id, subset, weighting, candidate_id, weight: bounded combinations of the pool.

    The selected by evidence over turnover, the four best with equal and with
    inverse-turnover weights, eight of mixed families, the eight calmest, the
    eight with the strongest correlation, then pairs of the four best over a
    grid of weights, until there are ``most``.
    """
    pool = composite_pool(factors)
    top = lambda n, *order: pool.orderBy(*order).limit(n)
    sets = [
        ("top8", "traditional", pool.where("selected")),
        ("top4", "equal", pool.where("place <= 4")),
        ("top4", "inverse_turnover", pool.where("place <= 4")),
        ("diverse8", "traditional", diverse(pool.withColumn("_merit", -F.col("place")), 8, score="_merit").drop("_merit")),
        ("low_turnover8", "inverse_turnover", top(8, _or("turnover", 999), _or("research_score", 0).desc(), "place")),
        ("high_ic8", "ic", top(8, _strength().desc(), "place")),
    ]
    out = None
    for k, (subset, how, some) in enumerate(sets):
        w = evidence_weights(some.withColumns({"composite_id": F.lit(k + 1), "subset": F.lit(subset), "weighting": F.lit(how)}), how)
        w = w.select("composite_id", "subset", "weighting", "candidate_id", "weight")
        out = w if out is None else out.unionByName(w)
    four = pool.where("place <= 4").select("candidate_id", "place", F.lit(1).alias("_k"))
    pairs = four.alias("a").join(four.alias("b"), "_k").where("a.place < b.place")  # six rows at most
    grid = pairs.withColumn("w", F.explode(F.array(*map(F.lit, PAIR_WEIGHTS))))
    place = F.row_number().over(Window.partitionBy("_k").orderBy("a.place", "b.place", "w"))
    grid = grid.withColumn("composite_id", place + len(sets)).where(F.col("composite_id") <= most)
    members = F.inline(F.array(F.struct(F.col("a.candidate_id").alias("candidate_id"), F.col("w").alias("weight")), F.struct(F.col("b.candidate_id").alias("candidate_id"), (1 - F.col("w")).alias("weight"))))
    grid = grid.select("composite_id", F.lit("pair_grid").alias("subset"), F.format_string("grid_%d_%d", F.round(F.col("w") * 100).cast("int"), F.round((1 - F.col("w")) * 100).cast("int")).alias("weighting"), members)
    several = pool.agg(F.count(F.lit(1)).alias("_n"), F.lit(1).alias("_k"))  # a pool of one gives the first set alone
    both = out.unionByName(grid).withColumn("_k", F.lit(1)).join(F.broadcast(several), "_k").where("composite_id = 1 or _n >= 2")
    return both.drop("_k", "_n")


def _proposal(kind: str, variant: str, when: Column, **changes: Column) -> Column:
    """A struct, or NULL where nothing changes."""
    some = F.coalesce(when, F.lit(False)) & F.greatest(*[c.isNotNull() for c in changes.values()], F.lit(False))
    cells = [changes.get(n, F.lit(None)).cast(t).alias(n) for n, t in CHANGES.items()]
    return F.when(some, F.struct(F.lit(kind).alias("kind"), F.lit(variant).alias("variant"), *cells))


def _listed(df: DataFrame, proposals: list[Column], most: int) -> DataFrame:
    first = F.slice(F.array_compact(F.array(*proposals)), 1, most)
    return df.select("candidate_id", F.inline(first))


def neighbour(column: str, ladder: tuple) -> Column:
    """The next value of the ladder, at its end the one before; NULL off the ladder."""
    steps = [*ladder[1:], ladder[-2]]
    out = F.lit(None)
    for value, step in zip(ladder, steps):
        out = F.when(F.col(column) == value, F.lit(step)).otherwise(out)
    return out


def _calmer() -> tuple[Column, dict[str, Column]]:
    """Calming parameters above the present ones, by how costly a factor's trading is."""
    costly = (_or("turnover", 0) >= 0.15) | (_or("cost_drag", 0) >= 0.5)
    target = {"smooth_span": (48, 24), "signal_threshold": (0.25, 0.15), "position_buffer": (0.20, 0.12)}
    goal = {c: F.when(costly, F.lit(a)).otherwise(F.lit(b)) for c, (a, b) in target.items()}
    return F.lit(True), {c: F.when(_or(c, 0) < g, g) for c, g in goal.items()}


def evolve(factors: DataFrame, parents: int = 16, per_parent: int = 3) -> DataFrame:
    """Proposals for the best ``parents`` among survivors: calmer, the next lookback, and the regime that pays best."""
    f = _factors(factors)
    alive = F.coalesce(F.col("passed"), F.lit(False)) | F.coalesce(F.col("research_status").isin("production_passed", "research_survivor"), F.lit(False))
    best = f.where(alive).orderBy(*by_merit()).limit(parents)
    pays = F.col("regime_filter").isNull() & (F.col("best_regime_sharpe") >= F.greatest(F.lit(0.4), _or("net_sharpe", 0) + 0.5))
    always, calm = _calmer()
    return _listed(best, [_proposal("evolution", "low_turnover", always, **calm), _proposal("evolution", "lookback", always, lookback=neighbour("lookback", LOOKBACKS)), _proposal("evolution", "regime_filter", pays, regime_filter=F.col("best_regime"))], per_parent)


def hill_climb(factors: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One step further for each candidate whose change helped.

    outcomes: candidate_id, status, changed (array of parameter names),
    delta_sharpe, delta_turnover. The first rule that applies decides.
    """
    d = _factors(factors).select(*NEEDS).join(outcomes.where("status = 'improved'").select("candidate_id", "changed", "delta_sharpe", "delta_turnover"), "candidate_id")
    sharpe, less = F.col("delta_sharpe"), F.coalesce(F.col("delta_turnover") <= -0.01, F.lit(False))
    changed = lambda *names: F.arrays_overlap("changed", F.array(*map(F.lit, names)))
    gained = sharpe.isNull() | (sharpe >= 0.05)
    # the first calming step that is not yet taken in full
    step = {c: F.lit(None).cast("double") for c in ("smooth_span", "signal_threshold", "position_buffer")}
    for span, level, room in reversed(CALM_STEPS):
        below = (_or("smooth_span", 1) < span) | (_or("signal_threshold", 0) < level) | (_or("position_buffer", 0.05) < room)
        step = {c: F.when(below, F.lit(float(v))).otherwise(step[c]) for c, v in zip(step, (span, level, room))}
    _, calm = _calmer()
    rules = [
        ("turnover", changed("smooth_span", "signal_threshold", "position_buffer") & (sharpe.isNull() | (sharpe >= -0.05)) & less & step["smooth_span"].isNotNull(), step),
        ("lookback", changed("lookback") & gained, {"lookback": neighbour("lookback", LOOKBACKS)}),
        ("regime_filter", changed("regime_filter") & gained, calm),
        ("zscore_window", changed("zscore_window") & gained, {"zscore_window": neighbour("zscore_window", ZSCORE_WINDOWS)}),
        ("tanh_scale", changed("tanh_scale") & gained, {"tanh_scale": neighbour("tanh_scale", TANH_SCALES)}),
    ]
    out, before = [], F.lit(False)
    for name, when, changes in rules:
        when = F.coalesce(when, F.lit(False))
        out.append(_proposal("hill_climb", name, when & ~before, **changes))
        before = before | when
    return _listed(d, out, 1)


def exits(factors: DataFrame, parents: int = 8, per_parent: int = 3, total: int = 24) -> DataFrame:
    """Exit rules for the best survivors: by drawdown, by holding time, and by what costs eat."""
    f = _factors(factors)
    best = f.where(has_evidence()).orderBy(*by_merit()).limit(parents)
    drawdown, long = _or("max_drawdown", 0), F.coalesce(F.col("avg_holding") > 500, F.lit(False))
    eaten = F.coalesce((F.col("cost_drag") > 0.5) & (F.coalesce("trade_count", F.lit(0)) >= 50), F.lit(False))
    lit = F.lit
    rows = [
        _proposal("exit", "drawdown_balanced", drawdown <= -0.12, stop_loss_pct=lit(-0.03), trailing_stop_pct=lit(0.02)),
        _proposal("exit", "drawdown_tight", drawdown <= -0.12, stop_loss_pct=lit(-0.02), trailing_stop_pct=lit(0.015)),
        _proposal("exit", "drawdown_moderate", (drawdown <= -0.08) & (drawdown > -0.12), stop_loss_pct=lit(-0.04), trailing_stop_pct=lit(0.025)),
        _proposal("exit", "max_hold_500", long, max_hold_bars=lit(500)),
        _proposal("exit", "max_hold_250", long, max_hold_bars=lit(250)),
        _proposal("exit", "profit_lock_balanced", eaten, tp_tier_pct=lit(0.02), tp_tier_fraction=lit(0.50), trailing_after_first_tp=lit(True)),
        _proposal("exit", "profit_lock_fast", eaten, tp_tier_pct=lit(0.01), tp_tier_fraction=lit(0.40), trailing_stop_pct=lit(0.015), trailing_after_first_tp=lit(True)),
    ]
    return _listed(best, rows, per_parent).limit(total)


def apply(factors: DataFrame, proposals: DataFrame) -> DataFrame:
    """Children: parameters of the parent with the changes, a new id, and root_parent_id; no results yet."""
    f = _factors(factors)
    keep = [c for c in CHANGES if c in f.columns]
    parent = f.select(F.col("candidate_id").alias("parent_id"), "family", F.coalesce("root_parent_id", "candidate_id").alias("root_parent_id") if "root_parent_id" in f.columns else F.col("candidate_id").alias("root_parent_id"), *[F.col(c).alias(f"_{c}") for c in keep])
    d = proposals.withColumnRenamed("candidate_id", "parent_id").join(parent, "parent_id")
    d = d.withColumns({c: F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.col(c)) for c in keep})  # what is as before is no change
    changed = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in CHANGES]))
    mark = F.sha2(F.concat_ws("|", "root_parent_id", "kind", F.to_json(F.struct(*CHANGES))), 256).substr(1, 16)
    out = d.withColumns({"changed": changed, "candidate_id": mark}).where(F.size("changed") > 0)
    return out.select("candidate_id", "parent_id", "root_parent_id", "family", "kind", "variant", "changed", *[F.coalesce(c, f"_{c}").alias(c) if c in keep else F.col(c) for c in CHANGES]).dropDuplicates(["candidate_id"])


def optimise(factors: DataFrame, evaluate: Callable[[DataFrame], DataFrame], rounds: int = 3) -> DataFrame:
    """Factors and what ``rounds`` of proposals made of them; adds parent_id, status and round.

    ``evaluate`` takes children (rows of ``apply``) and returns candidate_id
    with result columns of NEEDS: one backtest plan a round, however many
    candidates. Children seen before are not evaluated again; a round's rows
    are checkpointed, so that plans don't grow.
    """
    columns = [*NEEDS, "parent_id", "root_parent_id", "changed", "status", "round"]
    kinds = {"parent_id": "string", "root_parent_id": "string", "changed": "array<string>", "status": "string", "round": "int"}
    every = _factors(factors)
    every = every.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in every.columns}).select(*columns)
    every = durable(every)
    for k in range(1, rounds + 1):
        made = evolve(every.where(F.coalesce("round", F.lit(0)) == k - 1))
        if k > 1:
            parents = every.select(F.col("candidate_id").alias("parent_id"), F.col("net_sharpe").alias("_s"), F.col("turnover").alias("_t"))
            moved = every.where(F.col("status") == "improved").join(parents, "parent_id")
            moved = moved.select("candidate_id", "status", "changed", (F.col("net_sharpe") - F.col("_s")).alias("delta_sharpe"), (F.col("turnover") - F.col("_t")).alias("delta_turnover"))
            made = made.unionByName(hill_climb(every, moved))
        children = apply(every, made).join(every.select("candidate_id"), "candidate_id", "left_anti")
        own = children.select("candidate_id", "parent_id", "root_parent_id", "family", "changed", *[c for c in CHANGES if c in NEEDS])
        results = evaluate(children)
        done = own.join(results.select("candidate_id", *[c for c in results.columns if c in NEEDS and c not in own.columns]), "candidate_id")
        before = every.select(F.col("candidate_id").alias("parent_id"), F.col("research_score").alias("_s0"), F.col("net_sharpe").alias("_n0"))
        done = _factors(done).join(before, "parent_id").withColumns({"status": outcome(_or("research_score", 0) - F.coalesce("_s0", F.lit(0.0)), _or("net_sharpe", 0) - F.coalesce("_n0", F.lit(0.0))), "round": F.lit(k)})
        every = durable(every.unionByName(done.select(*columns)))
    return every
