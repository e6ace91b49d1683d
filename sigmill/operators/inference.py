"""Statistics of return series, and tests corrected for having tried many."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmill.functions import frames as fr

KEY = ("candidate_id",)
EULER = 0.5772156649015329


# ---- normal distribution --------------------------------------------------


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def inverse_normal_cdf(p: float) -> float:
    if not 0 < p < 1:
        raise ValueError(f"p must lie between 0 and 1, got {p}")
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


# Coefficients of a rational Chebyshev approximation of erfc (absolute error below 1.2e-7).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def cdf(x: Column) -> Column:
    """Normal distribution function as an expression (no built-in erf); error below 1e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    poly = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = poly * t + c
    tail = t * F.exp(poly - z * z) / 2
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def one_sided_p(t: Column) -> Column:
    return F.coalesce(fr.clip(1 - cdf(t), 0, 1), F.lit(1.0))


def combined_p(a: Column, b: Column) -> Column:
    return F.least(F.lit(1.0), 2 * F.least(one_sided_p(a), one_sided_p(b)))


# ---- aggregates -----------------------------------------------------------


def sharpe(x: Column, year: float) -> Column:
    s = F.stddev_samp(x)
    return F.coalesce(fr.divide(F.avg(x), F.when(s > 1e-15, s)) * math.sqrt(year), F.lit(0.0))


def moments(x: Column) -> list[Column]:
    """n, skew and raw kurtosis with the sample deviation (ddof 1) in the denominator; 0 and 3 if degenerate."""
    n = F.count(x)
    ratio = (n - 1) / n
    flat = (n < 3) | (F.coalesce(F.stddev_samp(x), F.lit(0.0)) <= 1e-15)
    safe = F.when(~flat, F.lit(1.0))
    skew = F.coalesce(safe * F.try_divide(F.skewness(x), F.lit(1.0)) * F.pow(ratio, F.lit(1.5)), F.lit(0.0))
    kurt = F.coalesce(safe * (F.kurtosis(x) + 3) * F.pow(ratio, F.lit(2.0)), F.lit(3.0))
    return [n.alias("n"), skew.alias("skew"), kurt.alias("kurtosis")]


def autocorrelation(df: DataFrame, column: str, keys=KEY, time: str = fr.TIME) -> DataFrame:
    p = df.withColumn("_before", F.lag(column).over(fr.line(keys, time)))
    return p.groupBy(*keys).agg(F.coalesce(fr.corr_agg(F.col(column), F.col("_before")), F.lit(0.0)).alias("autocorr1"))


def newey_west(df: DataFrame, column: str, *, lag: int | None = None, keys=KEY, time: str = fr.TIME) -> DataFrame:
    """t of the mean with Bartlett weights; lag: given or floor(n^(1/3)), at least 1, below n.

    A key's series is one array; products at all lags come from it in one
    grouped call, so the plan stays small for any lag.
    """

    def run(pdf):
        import pandas as pd

        x = pdf.sort_values(time, kind="stable")[column].to_numpy(float)
        x = x[np.isfinite(x)]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n": [len(x)], "tstat": [nw_t(x, lag)]})

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["n long", "tstat double"])
    return df.select(*dict.fromkeys([*keys, time, column])).groupBy(*keys).applyInPandas(run, schema)


def nw_t(x: np.ndarray, lag: int | None = None) -> float:
    n = len(x)
    if n < 3:
        return 0.0
    lag = max(1, min(int(n ** (1 / 3)) if lag is None else int(lag), n - 1))
    d = x - x.mean()
    v = sum((1 if k == 0 else 2) * (1 - k / (lag + 1)) * float(d[k:] @ d[: n - k]) / n for k in range(lag + 1))
    return float(x.mean() / math.sqrt(v / n)) if v > 0 else 0.0


def probabilistic_sharpe(sr: Column, n: Column, skew: Column, kurt: Column, year: float, benchmark: Column | float = 0.0) -> Column:
    """Chance that the true Sharpe ratio exceeds the benchmark (both annualised)."""
    scale = math.sqrt(max(1, int(year)))
    s, b = sr / scale, (benchmark if isinstance(benchmark, Column) else F.lit(float(benchmark))) / scale
    below = F.sqrt(F.greatest(F.lit(1e-12), 1 - skew * s + (kurt - 1) / 4 * s * s))
    return F.when(n >= 3, cdf((s - b) * F.sqrt(n - 1) / below)).otherwise(F.lit(0.0))


def expected_max_sharpe(trials: int, spread: float) -> float:
    """Expected best of ``trials`` null Sharpe ratios with standard deviation ``spread``."""
    if trials <= 1 or spread <= 0:
        return 0.0
    return spread * ((1 - EULER) * inverse_normal_cdf(1 - 1 / trials) + EULER * inverse_normal_cdf(1 - 1 / (trials * math.e)))


def haircut(sr: Column, trials: Column, n: Column, year: float) -> Column:
    """Sharpe ratio less the annualised penalty sqrt(2 ln trials / n)."""
    return sr - F.sqrt(2 * F.ln(F.greatest(trials, F.lit(1))) / F.greatest(n, F.lit(1))) * math.sqrt(max(1, int(year)))


# ---- many tests -----------------------------------------------------------


def benjamini_hochberg(df: DataFrame, p: str = "p", *, family: tuple[str, ...] = (), tests: Column | None = None, name: str = "q") -> DataFrame:
    """Step-up adjusted p-values within each family; ``tests``: how many were run, if more than there are rows."""
    w = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    n = F.count(F.lit(1)).over(w)
    total = n if tests is None else F.greatest(n, tests)
    rank = F.row_number().over(w.orderBy(p, *[c for c in df.columns if c != p and c not in family]))
    d = df.withColumn("_rank", rank).withColumn("_raw", F.col(p) * total / F.col("_rank"))
    least = F.min("_raw").over(w.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(name, F.least(F.lit(1.0), least)).drop("_rank", "_raw")


def family_fdr(df: DataFrame, trials: DataFrame, *, least: int = 10) -> DataFrame:
    """Per family: combined p of the two IC t-statistics, adjusted for max(batch, least, trials so far)."""
    d = df.join(trials.select("family", F.col("trials").alias("_trials")), "family", "left")
    d = d.withColumn("p", combined_p(F.col("ic_tstat"), F.col("rankic_tstat")))
    n = F.greatest(F.lit(least), F.coalesce("_trials", F.lit(0)))
    return benjamini_hochberg(d, "p", family=("family",), tests=n, name="fdr_p").drop("_trials")


def block_indices(n: int, resamples: int, block: int, seed: int) -> np.ndarray:
    """Stationary block bootstrap: geometric blocks, wrapping around; (resamples, n)."""
    r = np.random.default_rng(seed)
    new = r.random((resamples, n)) < 1 / max(1, min(block, n))
    new[:, 0] = True
    start = r.integers(0, n, (resamples, n))
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(new, place, 0), axis=1)
    return (np.take_along_axis(start, last, 1) + place - last) % n


def bootstrap_sharpe(df: DataFrame, column: str, *, year: float, resamples: int = 1000, block: int = 288, levels=(0.05, 0.95), seed: int = 42, keys=KEY, time: str = fr.TIME) -> DataFrame:
    """ci_low, ci_high of the Sharpe ratio; deterministic, in chunks of bounded memory."""

    def run(pdf):
        import pandas as pd

        x = pdf.sort_values(time, kind="stable")[column].to_numpy(float)
        x = x[np.isfinite(x)]
        out = (0.0, 0.0)
        if len(x) >= 3:
            got = []
            step = max(1, (1 << 22) // len(x))
            for lo in range(0, resamples, step):
                s = x[block_indices(len(x), min(step, resamples - lo), block, seed + lo)]
                d = s.std(1, ddof=1)
                got.append(np.where(d > 0, s.mean(1) / np.where(d > 0, d, 1), 0.0) * math.sqrt(year))
            out = tuple(np.quantile(np.concatenate(got), levels))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "ci_low": [out[0]], "ci_high": [out[1]]})

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["ci_low double", "ci_high double"])
    return df.select(*dict.fromkeys([*keys, time, column])).groupBy(*keys).applyInPandas(run, schema)


def permutation_p(df: DataFrame, x: str, y: str, *, shifts: int = 200, seed: int = 42, keys=KEY, time: str = fr.TIME) -> DataFrame:
    """p of |corr| under circular shifts of x, (k + 1) / (shifts + 1); 1 if degenerate."""

    def run(pdf):
        import pandas as pd

        d = pdf.sort_values(time, kind="stable")
        a, b = d[x].to_numpy(float), d[y].to_numpy(float)
        ok = np.isfinite(a) & np.isfinite(b)
        a, b, p = a[ok], b[ok], 1.0
        if len(a) >= 3 and a.std() > 0 and b.std() > 0:
            a, b = (a - a.mean()) / a.std(), (b - b.mean()) / b.std()
            # correlations at all shifts at once
            every = np.abs(np.fft.irfft(np.conj(np.fft.rfft(a)) * np.fft.rfft(b), len(a))) / len(a)
            drawn = every[np.random.default_rng(seed).integers(1, len(a), shifts)]
            p = float(((drawn >= every[0] - 1e-12).sum() + 1) / (shifts + 1))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "p": [p]})

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["p double"])
    return df.select(*dict.fromkeys([*keys, time, x, y])).groupBy(*keys).applyInPandas(run, schema)


def romano_wolf(pnl: DataFrame, *, family: str = "family", name: str = "factor_id", column: str = "net_return", resamples: int = 1000, block: int = 20, seed: int = 42, two_sided: bool = False) -> DataFrame:
    """Step-down family-wise adjusted p of positive means; ``pnl`` is complete in (name, time) per family."""

    def run(pdf):
        import pandas as pd

        m = pdf.pivot_table(index=fr.TIME, columns=name, values=column, fill_value=0.0).sort_index()
        x = m.to_numpy(float)
        n, k = x.shape
        p = np.ones(k)
        if n >= 3:
            fold = np.abs if two_sided else (lambda v: v)

            def student(mean, deviation):
                with np.errstate(invalid="ignore", divide="ignore"):
                    return np.where(deviation > 0, mean * math.sqrt(n) / deviation, np.nan)

            seen = fold(student(x.mean(0), x.std(0, ddof=1)))
            c, draws = x - x.mean(0), max(100, resamples)
            null = np.array([fold(student(s.mean(0), s.std(0, ddof=1))) for s in (c[i] for i in block_indices(n, draws, block, seed))])
            order = np.argsort(-np.nan_to_num(seen, nan=-np.inf), kind="stable")
            # the largest null statistic among the hypotheses not yet passed
            worst = np.maximum.accumulate(np.nan_to_num(null[:, order[::-1]], nan=-np.inf), axis=1)[:, ::-1]
            raw = ((worst >= seen[order]).sum(0) + 1) / (draws + 1)
            p[order] = np.minimum(1.0, np.maximum.accumulate(raw))
        return pd.DataFrame({family: pdf[family].iloc[0], name: m.columns, "fwer_p": p})

    kinds = dict(pnl.dtypes)
    return pnl.select(family, name, fr.TIME, column).groupBy(family).applyInPandas(run, f"`{family}` {kinds[family]}, `{name}` {kinds[name]}, fwer_p double")


def cscv_splits(groups: int = 8, most: int = 128, seed: int = 42) -> list[tuple[int, ...]]:
    """Training groups of each symmetric split: all of them, or ``most`` drawn evenly."""
    groups -= groups % 2
    if groups < 4:
        return []
    halves = [c for c in combinations(range(groups), groups // 2) if 0 in c]
    if len(halves) > most:
        pick = np.random.default_rng(seed).permutation(len(halves))[:most]
        halves = [halves[i] for i in sorted(pick)]
    return halves


def pbo(returns: DataFrame, *, groups: int = 8, own: int = 3, column: str = "net_return", key: str = "candidate_id") -> DataFrame:
    """Probability of backtest overfitting of each candidate.

    Sums, squares and counts by (candidate, group) are taken once; each split
    adds them up for Sharpe ratios in and out of sample. The in-sample winner
    (ties to the smaller key) is poor if fewer than half of all are no better
    out of sample. A candidate chosen ``own`` times or more has its own rate,
    the others that of the batch; alone it is 1.
    """
    spark = returns.sparkSession
    splits = cscv_splits(groups)
    p = returns.withColumns({"_rn": F.row_number().over(fr.line((key,))) - 1, "_n": F.count(F.lit(1)).over(fr.whole((key,)))})
    per = p.groupBy(key, F.least(F.lit(groups - 1), F.floor(F.col("_rn") * groups / F.col("_n"))).alias("g")).agg(F.sum(column).alias("s"), F.sum(F.col(column) ** 2).alias("q"), F.count(column).alias("n"))
    table = spark.createDataFrame([(i, g, g in train) for i, train in enumerate(splits) for g in range(groups)], "split int, g long, train boolean")
    part = per.join(F.broadcast(table), "g").groupBy("split", key, "train").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    variance = (F.col("q") - F.col("s") ** 2 / F.col("n")) / (F.col("n") - 1)
    score = F.coalesce(fr.divide(F.col("s") / F.col("n"), F.sqrt(F.when(variance > 1e-18, variance))), F.lit(0.0))
    both = part.withColumn("score", score).groupBy("split", key).agg(F.max(F.when(F.col("train"), F.col("score"))).alias("inside"), F.max(F.when(~F.col("train"), F.col("score"))).alias("outside"))
    w = Window.partitionBy("split")
    best = both.withColumns({"_first": F.row_number().over(w.orderBy(F.col("inside").desc(), key)), "_share": F.cume_dist().over(w.orderBy("outside"))}).where("_first = 1")
    chosen = best.groupBy(key).agg(F.count(F.lit(1)).alias("chosen"), F.count_if(F.col("_share") < 0.5).alias("poor"))
    batch = chosen.agg((F.sum("poor") / F.sum("chosen")).alias("batch"), F.lit(1).alias("_k"))
    every = returns.select(key).distinct().withColumn("_k", F.lit(1))
    every = every.join(F.broadcast(every.agg(F.count(F.lit(1)).alias("_many"), F.lit(1).alias("_k"))), "_k")
    out = every.join(chosen, key, "left").join(batch, "_k", "left")
    rate = F.when(F.col("chosen") >= own, F.col("poor") / F.col("chosen")).otherwise(F.col("batch"))
    return out.select(key, F.when((F.col("_many") < 2) | F.lit(not splits), F.lit(1.0)).otherwise(rate).alias("pbo"))


def rolling_ic(df: DataFrame, x: str, y: str, *, window: int = 288, least: int = 10, name: str = "ic", keys=KEY) -> DataFrame:
    """Trailing Pearson of up to ``window`` rows; 0 in the first least - 1 rows and for a constant side."""
    w = fr.trailing(window, keys)
    rn = F.row_number().over(fr.line(keys))
    return df.withColumn(name, F.when(rn >= least, F.coalesce(fr.correlation(F.col(x), F.col(y), window, w, 2), F.lit(0.0))).otherwise(F.lit(0.0)))


def rolling_rank_ic(df: DataFrame, x: str, y: str, *, window: int = 288, least: int = 10, name: str = "rank_ic", keys=KEY) -> DataFrame:
    """Trailing correlation of ordinal ranks (ties in order of time); one grouped NumPy pass."""
    kinds = dict(df.dtypes)

    def run(pdf):
        pdf = pdf.sort_values(fr.TIME, kind="stable")
        out = np.zeros(len(pdf))
        sides = [pdf[c].to_numpy(float) for c in (x, y)]
        ranks = lambda v: np.argsort(np.argsort(v, axis=-1, kind="stable"), axis=-1, kind="stable")

        def score(s, t):
            m = s.shape[-1]
            return 1 - 6 * ((ranks(s) - ranks(t)) ** 2).sum(-1) / (m * (m * m - 1))

        for i in range(least - 1, min(window - 1, len(out))):
            out[i] = score(*(v[: i + 1] for v in sides))
        if len(out) >= window:  # whole windows, many at a time
            views = [np.lib.stride_tricks.sliding_window_view(v, window) for v in sides]
            step = max(1, (1 << 20) // window)
            for lo in range(0, len(views[0]), step):
                out[window - 1 + lo : window - 1 + lo + step] = score(*(v[lo : lo + step] for v in views))
        return pdf.assign(**{name: out})

    own = df.select(*dict.fromkeys([*keys, fr.TIME, x, y]))
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in own.columns] + [f"`{name}` double"])
    return own.groupBy(*keys).applyInPandas(run, schema)


def rank_ic(df: DataFrame, x: str, y: str, keys=KEY) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = both.select(*keys, fr.average_rank(F.col(x), *keys).alias("_x"), fr.average_rank(F.col(y), *keys).alias("_y"))
    return r.groupBy(*keys).agg(fr.corr_agg(F.col("_x"), F.col("_y")).alias("rank_ic"))


def ic_by_horizon(bars: DataFrame, signal: str, horizons=(1, 3, 6, 12, 24, 48, 96), keys=KEY, price: str = "open") -> DataFrame:
    """horizon, ic and n: correlation of the signal with the return of the next h bars after it."""
    at = fr.line(keys)
    entry = F.lead(price, 1).over(at)
    d = bars.withColumns({f"_r{h}": fr.divide(F.lead(price, h + 1).over(at), entry) - 1 for h in horizons})
    g = d.groupBy(*keys).agg(*[c for h in horizons for c in (fr.corr_agg(F.col(signal), F.col(f"_r{h}")).alias(f"ic_{h}"), F.count(F.when(F.col(signal).isNotNull(), F.col(f"_r{h}"))).alias(f"n_{h}"))])
    pairs = F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"ic_{h}").alias("ic"), F.col(f"n_{h}").alias("n")) for h in horizons]))
    return g.select(*keys, pairs)


def conditional_ic(df: DataFrame, signal: str, returns: str, label: str, *, least: int = 50, keys=KEY) -> DataFrame:
    ok = df.where(F.col(signal).isNotNull() & F.col(returns).isNotNull())
    g = ok.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), fr.corr_agg(F.col(signal), F.col(returns)).alias("ic"))
    return g.where(F.col("n") >= least)


def quantile_spread(df: DataFrame, signal: str, returns: str, *, buckets: int = 5, least: int = 15, keys=KEY) -> DataFrame:
    """Mean return of the top bucket less the bottom one, in bps; buckets cut ordinal ranks at equal steps."""
    ok = df.where(F.col(signal).isNotNull() & F.col(returns).isNotNull())
    w = Window.partitionBy(*keys)
    r = F.row_number().over(w.orderBy(signal, fr.TIME))
    n = F.count(F.lit(1)).over(w)
    # bucket edges lie at 1 + k (n - 1) / buckets; a rank on an edge belongs below it
    b = F.greatest(F.lit(1), F.ceil((r - 1) * F.lit(buckets) / F.greatest(n - 1, F.lit(1))))
    d = ok.withColumns({"_b": b, "_n": n})
    top, bottom = (F.avg(F.when(F.col("_b") == k, F.col(returns))) for k in (buckets, 1))
    g = d.groupBy(*keys).agg(F.max("_n").alias("n"), ((top - bottom) * 10_000).alias("spread"))
    return g.select(*keys, F.when(F.col("n") >= least, F.coalesce("spread", F.lit(0.0))).otherwise(F.lit(0.0)).alias("spread_bps"))


def decay_quality(ic: DataFrame, keys=KEY) -> DataFrame:
    """1 - largest |IC| over the sum of |IC| across horizons, with the best horizon."""
    a = F.abs("ic")
    g = ic.groupBy(*keys).agg(F.max(a).alias("m"), F.sum(a).alias("s"), F.max_by("horizon", F.struct(a, -F.col("horizon"))).alias("best_horizon"), (F.min("ic") < 0).alias("neg"), (F.max("ic") > 0).alias("pos"))
    return g.select(*keys, "best_horizon", F.coalesce(1 - fr.divide(F.col("m"), F.when(F.col("s") > 0, F.col("s"))), F.lit(0.0)).alias("decay_quality"))


def conflicts(ic: DataFrame, *, least: float = 0.015, keys=KEY) -> DataFrame:
    """Whether some horizon or label has IC >= least and another <= -least."""
    return ic.groupBy(*keys).agg(((F.max("ic") >= least) & (F.min("ic") <= -least)).alias("conflict"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> list[Column]:
    p, d = k / n, 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return [(centre - half).alias("low"), (centre + half).alias("high")]


def summary(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """count, min, p25, median, p75, max; percentiles are items at the floor of q * (n - 1)."""
    a = F.sort_array(F.collect_list(column))
    g = df.groupBy(*keys).agg(F.count(column).alias("count"), a.alias("_a"))
    at = lambda q: F.get("_a", F.floor((F.col("count") - 1) * q).cast("int"))
    return g.select(*keys, "count", at(0.0).alias("min"), at(0.25).alias("p25"), at(0.5).alias("median"), at(0.75).alias("p75"), at(1.0).alias("max"))


def pbo_from_scores(df: DataFrame, score: str) -> Column:
    """Share of scores below their median."""
    m = df.agg(F.percentile(score, F.lit(0.5))).first()[0]
    return F.avg((F.col(score) < F.lit(m)).cast("double"))


def rotate(df: DataFrame, column: str, *, least: int, seed: int, keys=KEY, name: str = "rotated") -> DataFrame:
    """The column shifted circularly by a seeded number of rows, at least ``least`` from no shift."""
    p = df.withColumns({"_rn": F.row_number().over(fr.line(keys)) - 1, "_n": F.count(F.lit(1)).over(fr.whole(keys))})
    k = least + F.pmod(F.xxhash64(F.lit(seed), *keys), F.greatest(F.lit(1), F.col("_n") - 2 * least))
    source = p.select(*keys, F.pmod(F.col("_rn") + k, F.col("_n")).alias("_rn"), F.col(column).alias(name))
    return p.join(source, [*keys, "_rn"]).drop("_rn", "_n")


def plant(df: DataFrame, returns: str, alpha: float, *, seed: int = 7, keys=KEY, name: str = "signal") -> DataFrame:
    """A signal that knows the coming return with strength alpha: alpha * z + sqrt(1 - alpha^2) * noise."""
    w = fr.whole(keys)
    z = fr.divide(F.col(returns) - F.avg(returns).over(w), F.stddev_pop(returns).over(w))
    return df.withColumn(name, fr.clip((alpha * z + math.sqrt(max(0.0, 1 - alpha * alpha)) * F.randn(seed)) / 3, -1, 1))


def power_table(trials: DataFrame) -> DataFrame:
    """Pass rate by horizon and alpha, with the count."""
    return trials.groupBy("horizon", "alpha").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("passed").cast("double")).alias("rate"))


def least_alpha(table: DataFrame, level: float = 0.8) -> DataFrame:
    return table.groupBy("horizon").agg(F.min(F.when(F.col("rate") >= level, F.col("alpha"))).alias("least_alpha"))


def plant_regime(df: DataFrame, returns: str, label: str, kept: list[str], alpha: float, *, seed: int = 7, keys=KEY, name: str = "signal") -> DataFrame:
    """``plant`` in the regimes ``kept``, noise alone in the others: what a regime filter should help."""
    d = plant(df, returns, alpha, seed=seed, keys=keys, name="_edge").withColumn("_noise", fr.clip(F.randn(seed + 1) / 3, -1, 1))
    return d.withColumn(name, F.when(F.col(label).isin(*kept), F.col("_edge")).otherwise(F.col("_noise"))).drop("_edge", "_noise")


def gate_rates(items: DataFrame, gates: tuple[str, ...], *, arm: str = "arm", trial: str = "trial") -> DataFrame:
    """How often each gate, and all of them at once (ALL), let trials of an arm pass.

    ``items`` (arm, trial, rule_id, status) are gate items of trials with
    rotated signals (false acceptances) or planted ones (power); a gate that a
    trial lacks counts as failed.
    """
    ok = F.col("status") == "pass"
    per = items.where(F.col("rule_id").isin(*gates)).groupBy(arm, trial).agg(*[F.coalesce(F.bool_or(F.when(F.col("rule_id") == g, ok)), F.lit(False)).alias(g) for g in gates])
    every = per.withColumn("ALL", F.array_min(F.array(*gates)))
    long = every.select(arm, F.inline(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("ok")) for g in (*gates, "ALL")])))
    return long.groupBy(arm, "gate").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("passed"), F.avg(F.col("ok").cast("double")).alias("rate"))
