"""Candidate generation as rows: grids, repairs, composites, budgets, crossover."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmill.functions import frames as fr
from sigmill.plans import expr

# Boundary of each family (most trials, least OOS/IS IC, least break-even multiple, short allowed).
BOUNDARIES = {
    "mean_reversion": (200, 0.25, 3.0, True),
    "trend_following": (200, 0.25, 2.0, True),
    "volume_confirmation": (100, 0.20, 3.0, True),
    "session_effects": (50, 0.30, 5.0, True),
    "funding_basis": (150, 0.40, 2.0, False),
}
DEFAULT_BOUNDARY = (100, 0.25, 2.0, True)
# Bounds of exit parameters.
EXIT_BOUNDS = {"stop_loss_pct": (-0.15, -0.01), "max_hold_bars": (10, 2000), "tp_tier_pct": (0.005, 0.20), "tp_tier_fraction": (0.10, 0.90), "trailing_stop_pct": (0.005, 0.10)}
MOST_TIERS = 4
# Shares of the evolutionary budget.
BUDGET = {"exploit": 0.4, "variation": 0.3, "targeted_repair": 0.2, "seed": 0.1}


def cross_candidates(hypotheses: DataFrame, symbols: DataFrame, indicators: DataFrame, variants=("base", "inverse", "low_turnover")) -> DataFrame:
    """Hypotheses with their family's indicators, for every symbol and variant.

    The rows are many more than those of the tables, and families few:
    hypotheses are dealt by hash, so that each family's rows are made in many
    tasks, and each executor holds indicators and symbols once. Nothing but the
    hypotheses is shuffled; the rows are made where they are written.
    """
    spread = 4 * max(12, int(hypotheses.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    v = F.explode(F.array(*[F.lit(x) for x in variants]))
    d = hypotheses.repartition(spread, "hypothesis_id").join(F.broadcast(indicators), "family").withColumn("variant", v)
    d = d.crossJoin(F.broadcast(symbols))
    return d.withColumn("candidate_id", F.sha2(F.concat_ws("|", "hypothesis_id", "symbol", "indicator", "variant"), 256).substr(1, 16))


def grid(parents: DataFrame, axes: dict[str, list], *, per_parent: int = 64, total: int = 256, score: Column | None = None) -> DataFrame:
    """Every combination of the axes for each parent, ranked; at most ``per_parent`` each and ``total`` in all."""
    d = parents
    for name, values in axes.items():
        d = d.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    d = d.withColumn("score", score if score is not None else F.lit(0.0))
    order = [F.col("score").desc(), *axes]
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("parent_id").orderBy(*order))).where(F.col("_n") <= per_parent).drop("_n")
    return d.orderBy(F.col("score").desc(), "parent_id", *axes).limit(total)


def conservatism() -> Column:
    """How much a grid point calms a signal; columns smooth_span, signal_threshold, position_buffer, entry_band."""
    return F.log2(F.greatest(F.lit(1.0), F.col("smooth_span").cast("double"))) + 4 * F.col("signal_threshold") + 2 * F.col("position_buffer") + 4 * F.col("entry_band")


def acquisition(priority: Column, severity: Column, complexity: Column, changes: Column) -> Column:
    return priority + (0.45 * severity - 0.10) * conservatism() + 0.05 * changes - 0.25 * F.greatest(F.lit(0), complexity - 2)


def complexity() -> Column:
    """Additive complexity of a candidate row (columns may be NULL)."""
    c = F.col
    has = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    calm = (c("signal_threshold") > 0) | (c("smooth_span") > 1) | (F.abs(c("position_buffer") - 0.05) > 1e-12)
    return 1 + has(c("lookback").isNotNull()) + has(calm) + has(F.size("filters") > 0) * F.coalesce(F.size("filters"), F.lit(0)) + has(c("side_mode").isin("long_only", "short_only")) + F.coalesce(c("components"), F.lit(0))


def top_per_parent(df: DataFrame, k: int, *, parent: str = "parent_id", score: str = "score", tie: str = "candidate_id") -> DataFrame:
    w = Window.partitionBy(parent).orderBy(F.col(score).desc(), tie)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def merge_pool(repairs: DataFrame, *, most_complexity: int = 6, most_pbo: float = 0.5, most_corr: float = 0.8, per_parent: int = 4, tuned_per_parent: int = 3) -> DataFrame:
    """Add status and reason: rows are rejected by family, complexity, overfitting and correlation first, then caps hold over the accepted in order of score."""
    c = F.col
    tuned = F.coalesce(c("is_tuning"), F.lit(False))
    reason = (
        F.when(c("parent_family").isNull(), "parent_missing_validation")
        .when(c("family") != c("parent_family"), "cross_family_mutation")
        .when(c("complexity") > most_complexity, "complexity_cap")
        .when(F.coalesce("pbo", F.lit(1.0)) > most_pbo, "high_validation_pbo")
        .when(~tuned & c("parent_corr").isNull(), "missing_parent_correlation")
        .when(~tuned & (F.abs("parent_corr") >= most_corr), "low_incremental_orthogonality")
    )
    d = repairs.withColumns({"_why": reason, "_tuned": tuned})
    w = Window.partitionBy("parent_id", "_tuned", F.col("_why").isNull()).orderBy(c("score").desc(), "candidate_id")
    n = F.row_number().over(w)
    d = d.withColumn("_why", F.when(c("_why").isNotNull(), c("_why")).when(c("_tuned") & (n > tuned_per_parent), "local_tuning_parent_ratio_cap").when(~c("_tuned") & (n > per_parent), "repair_parent_ratio_cap"))
    return d.withColumns({"status": F.when(c("_why").isNull(), "merged").otherwise("rejected"), "reason": c("_why")}).drop("_why", "_tuned")


def boundaries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in BOUNDARIES.items()], "family string, most_trials int, least_ic_ratio double, least_break_even double, short_allowed boolean")


def within_boundary(families: DataFrame) -> DataFrame:
    """Add continue and reason; columns family, trials, oos_ic_ratio, break_even_multiple, uses_short."""
    d = families.join(F.broadcast(boundaries(families.sparkSession)), "family", "left")
    most, ic, even, short = (F.coalesce(c, F.lit(v)) for c, v in zip(("most_trials", "least_ic_ratio", "least_break_even", "short_allowed"), DEFAULT_BOUNDARY))
    why = F.when(F.col("trials") >= most, "max trials reached").when(F.col("oos_ic_ratio") < ic, "OOS/IS IC ratio too low").when(F.col("break_even_multiple") < even, "break-even multiple too low").when(F.col("uses_short") & ~short, "short side is blocked")
    return d.withColumn("reason", F.coalesce(why, F.lit("all boundaries satisfied"))).withColumn("continue", why.isNull()).select(*families.columns, "continue", "reason")


def funded(candidates: DataFrame, bars: DataFrame, rate: str = "funding_rate") -> DataFrame:
    """Candidates (symbol, family, expression) that don't need funding, and the others where an instrument has some.

    Funding is needed by the family funding_basis and by expressions with $funding_rate.
    """
    usable = bars.groupBy("symbol").agg((F.sum(F.abs(F.coalesce(fr.finite(F.col(rate).cast("double")), F.lit(0.0)))) > 1e-12).alias("_usable"))
    needs = (F.col("family") == "funding_basis") | F.coalesce(F.col("expression").rlike(r"\$funding_rate\b"), F.lit(False))
    d = candidates.join(F.broadcast(usable.where("_usable")), "symbol", "left")
    return d.where(~needs | F.coalesce("_usable", F.lit(False))).select(*candidates.columns)


def evidence_weights(df: DataFrame, how: str = "traditional", *, group: str = "composite_id") -> DataFrame:
    """Add weight, adding up to 1 in each group: equal, inverse_turnover, ic, or evidence over turnover (traditional)."""
    c = F.col
    ic = F.greatest(F.abs(F.coalesce("ic_tstat", F.lit(0.0))), F.abs(F.coalesce("rankic_tstat", F.lit(0.0))))
    calm = 1 / fr.clip(F.coalesce("turnover", F.lit(0.10)), 0.02, 1.0)
    fallback = F.coalesce(F.when(ic > 0, ic), F.when(c("research_score") != 0, c("research_score")), F.when(c("gross_sharpe") != 0, c("gross_sharpe")), F.lit(1.0))
    raw = {"equal": F.lit(1.0), "inverse_turnover": calm, "ic": ic}.get(how, fr.clip(fallback, 0.25, 4.0) * calm)
    w = Window.partitionBy(group)
    d = df.withColumn("_raw", raw)
    total, n = F.sum("_raw").over(w), F.count(F.lit(1)).over(w)
    return d.withColumn("weight", F.when(total > 0, fr.divide(c("_raw"), F.when(total > 0, total))).otherwise(1.0 / n)).drop("_raw")


def diverse(df: DataFrame, k: int, *, family: str = "family", score: str = "score") -> DataFrame:
    """The best of each family first, then the second of each, and so on, up to k rows."""
    w = Window.partitionBy(family).orderBy(F.col(score).desc(), "candidate_id")
    return df.withColumn("_r", F.row_number().over(w)).orderBy("_r", F.col(score).desc(), "candidate_id").limit(k).drop("_r")


def pairs(df: DataFrame, k: int, *, score: str = "score") -> DataFrame:
    """Pairs of the k best: composite_id, candidate_id rows."""
    top = df.orderBy(F.col(score).desc(), "candidate_id").limit(k).select("candidate_id")
    a, b = top.select(F.col("candidate_id").alias("a"), F.lit(1).alias("_k")), top.select(F.col("candidate_id").alias("b"), F.lit(1).alias("_k"))
    return a.join(b, "_k").where("a < b").select(F.concat_ws("+", "a", "b").alias("composite_id"), F.explode(F.array("a", "b")).alias("candidate_id"))


def clamp_exits(df: DataFrame) -> DataFrame:
    """Exit parameters held within bounds; 0 (off) stays 0."""
    b = EXIT_BOUNDS
    stop = F.when(F.col("stop_loss_pct") >= 0, 0.0).otherwise(fr.clip(F.col("stop_loss_pct"), *b["stop_loss_pct"]))
    hold = F.when(F.col("max_hold_bars") <= 0, 0).otherwise(fr.clip(F.col("max_hold_bars").cast("double"), *b["max_hold_bars"])).cast("int")
    trail = F.when(F.col("trailing_stop_pct") <= 0, 0.0).otherwise(fr.clip(F.col("trailing_stop_pct"), *b["trailing_stop_pct"]))
    return df.withColumns({"stop_loss_pct": stop, "max_hold_bars": hold, "trailing_stop_pct": trail})


def outcome(delta_score: Column, delta_sharpe: Column) -> Column:
    """improved, failed or neutral against the parent."""
    return F.when((delta_score > 0) | (delta_sharpe > 0.1), "improved").when((delta_score < 0) | (delta_sharpe < -0.1), "failed").otherwise("neutral")


def allocate_budget(total: int, available: dict[str, int], weights: dict[str, float] | None = None) -> dict[str, int]:
    """Slots by category: its share, no more than there are; what is left goes to exploit."""
    weights = weights or BUDGET
    got = {k: min(max(0, round(total * w)), available.get(k, 10**9 if k == "seed" else 0)) for k, w in weights.items()}
    left = total - sum(got.values())
    got["exploit"] = got.get("exploit", 0) + max(0, min(left, available.get("exploit", 0) - got.get("exploit", 0)))
    return got


def crossover(survivors: list[dict], known: set[str], *, most_complexity: int = 40, limit: int = 8) -> list[dict]:
    """A + B and A - B of survivors' expressions from different families, if new, valid and not too complex."""
    out: list[dict] = []
    for (i, a), (j, b) in product(enumerate(survivors), repeat=2):
        if i >= j or a["family"] == b["family"]:
            continue
        for sign in ("+", "-"):
            text = f"({a['expression']}) {sign} ({b['expression']})"
            try:
                tree = expr.parse(text)
            except expr.ExpressionError:
                continue
            mark = expr.fingerprint(tree)
            if mark in known or expr.complexity(tree) > most_complexity:
                continue
            known = known | {mark}
            out.append({"expression": expr.render(expr.canonicalize(tree)), "fingerprint": mark, "parents": [a["candidate_id"], b["candidate_id"]]})
            if len(out) == limit:
                return out
    return out


def freeze_point(text: str, depth: int) -> str:
    """The expression down to ``depth``, with what lies below replaced by its first leaf."""

    def cut(node: expr.Node, left: int) -> expr.Node:
        if not node.args or left == 0:
            return node if not node.args else expr.leaf(sorted(expr.leaves(node) or {"$close"})[0])
        at = expr.window_place(node.op)
        return expr.Node(node.op, node.value, tuple(a if i == at else cut(a, left - 1) for i, a in enumerate(node.args)))

    return expr.render(cut(expr.parse(text), depth))
