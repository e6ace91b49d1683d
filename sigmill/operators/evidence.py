"""Evidence on a candidate's signal: what it predicts, how far ahead, in which states, and at what cost."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.functions import frames as fr
from sigmill.functions.scratch import durable

from . import inference, simulate

HORIZONS = (1, 3, 6, 12, 24, 48, 96)
KEYS = simulate.KEYS


def ic_interval(df: DataFrame, x: str, y: str, *, resamples: int = 64, levels=(0.05, 0.95), seed: int = 42, keys=KEYS) -> DataFrame:
    """ci_low, ci_high of the correlation by a circular block bootstrap with blocks of sqrt(n) rows."""

    def run(pdf):
        import pandas as pd

        d = pdf.sort_values(fr.TIME, kind="stable")
        a, b = d[x].to_numpy(float), d[y].to_numpy(float)
        ok = np.isfinite(a) & np.isfinite(b)
        a, b, out = a[ok], b[ok], (0.0, 0.0)
        n = len(a)
        if n >= 10 and a.std() > 0 and b.std() > 0:
            block = max(1, int(n**0.5))
            r, got = np.random.default_rng(seed), []
            for _ in range(resamples):
                i = ((r.integers(0, n, -(-n // block))[:, None] + np.arange(block)) % n).ravel()[:n]
                if a[i].std() > 0 and b[i].std() > 0:
                    got.append(np.corrcoef(a[i], b[i])[0, 1])
            out = tuple(np.quantile(got, levels)) if got else out
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "ci_low": [out[0]], "ci_high": [out[1]]})

    kinds = dict(df.dtypes)
    own = df.select(*dict.fromkeys([*keys, fr.TIME, x, y]))
    return own.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", ci_low double, ci_high double")


def by_horizon(path: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Long: key, horizon, ic, rank_ic, spread_bps, ci_low, ci_high of the executable signal."""
    at = fr.line(KEYS)
    out = None
    for h in horizons:
        d = path.withColumn("_y", fr.divide(F.lead("open", h).over(at), F.col("open")) - 1)
        g = d.groupBy(*KEYS).agg(fr.corr_agg(F.col("executable"), F.col("_y")).alias("ic"))
        g = g.join(inference.rank_ic(d, "executable", "_y", KEYS), list(KEYS), "left").join(inference.quantile_spread(d, "executable", "_y", keys=KEYS), list(KEYS), "left")
        g = g.join(ic_interval(d, "executable", "_y", seed=42 + h), list(KEYS), "left").withColumn("horizon", F.lit(h))
        out = g if out is None else out.unionByName(g)
    return out


def by_label(path: DataFrame, label: str, horizons=HORIZONS, least: int = 50) -> DataFrame:
    """Long: key, label, horizon, ic, n, for labels with at least ``least`` rows."""
    at = fr.line(KEYS)
    returns = F.array(*[F.struct(F.lit(h).alias("horizon"), (fr.divide(F.lead("open", h).over(at), F.col("open")) - 1).alias("y")) for h in horizons])
    d = path.withColumn("_r", returns).select(*KEYS, label, "executable", F.inline("_r"))
    g = d.where("y is not null").groupBy(*KEYS, F.col(label).alias("label"), "horizon").agg(F.count(F.lit(1)).alias("n"), fr.corr_agg(F.col("executable"), F.col("y")).alias("ic"))
    return g.where(F.col("n") >= least)


def sides(path: DataFrame, costs: simulate.Costs = simulate.Costs(), year: float = 105_120.0) -> DataFrame:
    """Sharpe ratios of the long and of the short half of the position."""
    out = None
    for name, low, high in (("long_sharpe", 0.0, 1e9), ("short_sharpe", -1e9, 0.0)):
        half = simulate.strategy_returns(path.withColumn("position", fr.clip(F.col("position"), low, high)), costs)
        m = simulate.metrics(half, year=year).select(*KEYS, F.col("sharpe").alias(name))
        out = m if out is None else out.join(m, list(KEYS))
    return out


def report(path: DataFrame, *, label: str | None = None, horizons=HORIZONS, costs: simulate.Costs = simulate.Costs(), year: float = 105_120.0) -> DataFrame:
    """One row a key with the fields that tiers, research gate and near misses read.

    ``path``: output of ``simulate.backtest``; ``label``: a column of states.
    The path, and the measures by horizon, are checkpointed once: every figure
    reads them, and none runs the backtest again.
    """
    path = durable(path)
    h = durable(by_horizon(path, horizons))
    a = F.abs("ic")
    best = h.groupBy(*KEYS).agg(
        F.max(a).alias("max_abs_ic"), F.max(F.abs("rank_ic")).alias("max_abs_rankic"), F.max(F.abs("spread_bps")).alias("max_abs_spread"),
        F.max_by("horizon", F.struct(a, -F.col("horizon"))).cast("long").alias("best_horizon"), F.max(((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).cast("int")).alias("_ci"),
        F.map_from_entries(F.collect_list(F.struct("horizon", "ic"))).alias("ic_by_horizon"),
    )
    out = best.withColumn("ic_ci_excludes_zero", F.col("_ci") == 1).drop("_ci").join(inference.decay_quality(h, KEYS).drop("best_horizon"), list(KEYS)).join(sides(path, costs, year), list(KEYS))
    out = out.withColumn("long_short_spread_sharpe", F.col("long_sharpe") - F.col("short_sharpe"))
    m = simulate.metrics(path, year=year).select(*KEYS, F.col("sharpe").alias("net_sharpe"), "total_return")
    gross = simulate.metrics(path, returns="gross_return", year=year).select(*KEYS, F.col("sharpe").alias("gross_sharpe"))
    moved = path.groupBy(*KEYS).agg(F.avg("turnover").alias("turnover"))
    out = out.join(m, list(KEYS)).join(gross, list(KEYS)).join(moved, list(KEYS))
    out = out.withColumn("turnover_adjusted_return", F.col("total_return") / F.greatest(F.col("turnover"), F.lit(1e-6)))
    parts = h.select(*KEYS, "ic")
    if label is not None:
        c = by_label(path, label, horizons)
        parts = parts.unionByName(c.select(*KEYS, "ic"))
        top = c.groupBy(*KEYS).agg(F.max(F.abs("ic")).alias("max_abs_regime_ic"), F.max_by("label", F.abs("ic")).alias("best_regime"))
        out = out.join(top, list(KEYS), "left")
    return out.join(inference.conflicts(parts, keys=KEYS).withColumnRenamed("conflict", "regime_conflict"), list(KEYS), "left")
