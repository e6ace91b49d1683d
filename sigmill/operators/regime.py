"""Market regimes: rolling labels, and a Gaussian hidden Markov model in NumPy."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.functions import frames as fr

BARS_60D = 60 * 24 * 12


def running_rank(x: np.ndarray, least: int) -> np.ndarray:
    """Percentile rank (ties averaged) of each value among all so far; NaN before ``least`` values."""
    seen: list[float] = []
    out = np.full(len(x), np.nan)
    for i, v in enumerate(x):
        if not np.isfinite(v):
            continue
        insort(seen, v)
        if len(seen) >= least:
            out[i] = (bisect_left(seen, v) + 1 + bisect_right(seen, v)) / 2 / len(seen)
    return out


def rolling_labels(bars: DataFrame, *, window: int = BARS_60D, bull: float = 0.2, bear: float = -0.2, high_vol: float = 0.85, name: str = "regime", keys=fr.KEYS) -> DataFrame:
    """bull or bear by the return over the window, else high_vol by the running rank of volatility, else sideways."""
    least = max(10, window // 10)
    at = fr.line(keys)
    c = F.col("close")
    d = bars.withColumns({"_ret": fr.divide(c, F.lag(c, window).over(at)) - 1, "_r1": fr.divide(c, F.lag(c).over(at)) - 1})
    d = d.withColumn("_vol", fr.std(F.col("_r1"), window, fr.trailing(window, keys), least))

    def rank(pdf):
        pdf = pdf.sort_values(fr.TIME, kind="stable")
        return pdf.assign(_rank=running_rank(pdf["_vol"].to_numpy(float), least)).drop(columns="_vol")

    own = d.select(*keys, fr.TIME, "_vol")
    kinds = dict(own.dtypes)
    got = own.groupBy(*keys).applyInPandas(rank, ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, fr.TIME]) + ", _rank double")
    d = d.join(got, [*keys, fr.TIME])
    label = F.when(F.col("_ret") > bull, "bull").when(F.col("_ret") < bear, "bear").when(F.col("_rank") > high_vol, "high_vol").otherwise("sideways")
    return d.withColumn(name, label).drop("_ret", "_r1", "_vol", "_rank")


def model_features(bars: DataFrame, keys=fr.KEYS) -> DataFrame:
    """Inputs of the model: returns over 1, 12, 48 bars, volatility 20, 50, volume ratio, close position."""
    at, c = fr.line(keys), F.col("close")
    back = lambda n: fr.finite(F.ln(fr.divide(c, F.lag(c, n).over(at))))
    d = bars.withColumns({"f_ret_1": back(1), "f_ret_12": back(12), "f_ret_48": back(48)})
    vol = lambda n: fr.full(F.stddev_pop("f_ret_1"), F.col("f_ret_1"), n, fr.trailing(n, keys))
    span = F.col("high") - F.col("low")
    return d.withColumns(
        {
            "f_vol_20": vol(20), "f_vol_50": vol(50),
            "f_volume": fr.divide(F.col("volume"), F.when(fr.mean(F.col("volume"), 20, fr.trailing(20, keys)) > 0, fr.mean(F.col("volume"), 20, fr.trailing(20, keys)))),
            "f_place": F.coalesce(fr.divide(c - F.col("low"), F.when(span > 0, span)), F.lit(0.5)),
        }
    )


FEATURES = ("f_ret_1", "f_ret_12", "f_ret_48", "f_vol_20", "f_vol_50", "f_volume", "f_place")


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


@dataclass
class MarkovModel:
    """Hidden states with diagonal Gaussian outputs, fitted by expectation maximisation."""

    states: int = 5
    rounds: int = 50
    tolerance: float = 1e-2
    seed: int = 42
    labels: dict[int, str] = field(default_factory=dict)

    def fit(self, x: np.ndarray) -> MarkovModel:
        x = x[np.isfinite(x).all(1)]
        if len(x) < 10 * self.states:
            raise ValueError("too few complete rows to fit")
        self.centre, self.spread = x.mean(0), np.maximum(x.std(0), 1e-12)
        z = (x - self.centre) / self.spread
        r = np.random.default_rng(self.seed)
        k, n = self.states, len(z)
        own = np.argsort(np.argsort(z[:, 1])) * k // n  # start from slices of the 12-bar return
        self.mean = np.array([z[own == s].mean(0) for s in range(k)]) + 1e-3 * r.standard_normal((k, z.shape[1]))
        self.var = np.array([np.maximum(z[own == s].var(0), 1e-2) for s in range(k)])
        self.start = np.full(k, 1 / k)
        self.move = np.full((k, k), 0.1 / (k - 1)) + (0.9 - 0.1 / (k - 1)) * np.eye(k)
        last = -np.inf
        for _ in range(self.rounds):
            out = self._log_density(z)
            with np.errstate(divide="ignore"):
                log_move = np.log(self.move)
            a, b = self._forward(out, log_move), self._backward(out, log_move)
            total = _log_sum(a[-1], 0)
            g = np.exp(a + b - total)
            pair = np.zeros((k, k))
            for lo in range(0, n - 1, 4096):
                hi = min(n - 1, lo + 4096)
                pair += np.exp(a[lo:hi, :, None] + log_move + (out[lo + 1 : hi + 1] + b[lo + 1 : hi + 1])[:, None, :] - total).sum(0)
            weight = g.sum(0) + 1e-12
            self.start = g[0] / g[0].sum()
            self.move = (pair + 1e-6) / (pair + 1e-6).sum(1, keepdims=True)
            self.mean = g.T @ z / weight[:, None]
            self.var = np.maximum(g.T @ z**2 / weight[:, None] - self.mean**2, 1e-3)
            if total - last < self.tolerance:
                break
            last = total
        return self

    def _log_density(self, z: np.ndarray) -> np.ndarray:
        return np.stack([-0.5 * (((z - m) ** 2 / v) + np.log(2 * np.pi * v)).sum(1) for m, v in zip(self.mean, self.var)], 1)

    def _forward(self, out: np.ndarray, log_move: np.ndarray) -> np.ndarray:
        a = np.empty_like(out)
        with np.errstate(divide="ignore"):
            a[0] = np.log(self.start) + out[0]
        for t in range(1, len(out)):
            a[t] = out[t] + _log_sum(a[t - 1][:, None] + log_move, 0)
        return a

    def _backward(self, out: np.ndarray, log_move: np.ndarray) -> np.ndarray:
        b = np.zeros_like(out)
        for t in range(len(out) - 2, -1, -1):
            b[t] = _log_sum(log_move + out[t + 1] + b[t + 1], 1)
        return b

    def _inputs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.isfinite(x).all(1)
        return ok, self._log_density((x[ok] - self.centre) / self.spread)

    def filtered(self, x: np.ndarray) -> np.ndarray:
        """Causal state probabilities: row t uses rows up to t. NaN for incomplete rows."""
        ok, out = self._inputs(x)
        full = np.full((len(x), self.states), np.nan)
        if ok.any():
            a = self._forward(out, np.log(self.move))
            full[ok] = np.exp(a - _log_sum(a, 1)[:, None])
        return full

    def smoothed(self, x: np.ndarray) -> np.ndarray:
        """State probabilities given all rows (not causal)."""
        ok, out = self._inputs(x)
        full = np.full((len(x), self.states), np.nan)
        if ok.any():
            g = self._forward(out, np.log(self.move)) + self._backward(out, np.log(self.move))
            full[ok] = np.exp(g - _log_sum(g, 1)[:, None])
        return full

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Most likely path; -1 for incomplete rows."""
        ok, out = self._inputs(x)
        path = np.full(len(x), -1)
        if not ok.any():
            return path
        log_move, best = np.log(self.move), np.empty_like(out)
        back = np.zeros(out.shape, int)
        best[0] = np.log(self.start) + out[0]
        for t in range(1, len(out)):
            s = best[t - 1][:, None] + log_move
            back[t] = s.argmax(0)
            best[t] = out[t] + s.max(0)
        state = int(best[-1].argmax())
        got = [state]
        for t in range(len(out) - 1, 0, -1):
            state = int(back[t, state])
            got.append(state)
        path[ok] = got[::-1]
        return path

    def ahead(self, p: np.ndarray, steps: int) -> np.ndarray:
        """Probabilities ``steps`` bars on."""
        return p @ np.linalg.matrix_power(self.move, steps)

    def stationary(self) -> np.ndarray:
        values, vectors = np.linalg.eig(self.move.T)
        v = np.abs(np.real(vectors[:, np.argmin(np.abs(values - 1))]))
        return v / v.sum()

    def name_states(self, path: np.ndarray, close: np.ndarray, year: int = 105_120) -> dict[int, str]:
        """Names by rank of mean return; middle states with high volatility are high_vol.

        States seen on fewer than 10 bars are unknown.
        """
        r = np.diff(np.log(close))
        stats = {s: (r[path[1:] == s].mean() * year, r[path[1:] == s].std() * np.sqrt(year)) for s in range(self.states) if (path[1:] == s).sum() >= 10}
        self.labels = {int(s): "unknown" for s in np.unique(path)}
        order = sorted(stats, key=lambda s: stats[s][0])
        n, usual = len(order), np.mean([v for _, v in stats.values()]) if stats else 0.0
        loud = 1.25 if n == 5 else 1.3
        for rank, s in enumerate(order):
            if rank in (0, n - 1):
                name = "bull" if rank and rank == n - 1 else "bear"
            elif stats[s][1] > usual * loud:
                name = "high_vol"
            else:
                name = {1: "bear", 3: "bull"}.get(rank, "sideways") if n == 5 else "sideways"
            self.labels[s] = name
        return self.labels


def model_regimes(bars: DataFrame, *, states: int = 5, horizon: int = 12, lag: int = 1, keys=fr.KEYS) -> DataFrame:
    """Forward regime of each bar: fit on the first third (100 to 50,000 bars), then causal filtering.

    Rows of the fitting prefix, and instruments that cannot be fitted, are unknown.
    """
    kinds = dict(bars.dtypes)

    def run(pdf):
        pdf = pdf.sort_values(fr.TIME, kind="stable")
        x, out = pdf[list(FEATURES)].to_numpy(float), np.full(len(pdf), "unknown", object)
        cut = min(50_000, max(100, len(pdf) // 3))
        if len(pdf) > cut:
            try:
                model = MarkovModel(states).fit(x[:cut])
                names = model.name_states(model.decode(x[:cut]), pdf["close"].to_numpy(float)[:cut])
                p = model.ahead(model.filtered(x), horizon)
                ok = np.isfinite(p).all(1)
                best = np.array([names.get(int(s), "sideways") for s in np.nan_to_num(p).argmax(1)], object)
                out = np.where(ok, best, "unknown")
                out = np.concatenate([np.full(lag, "unknown", object), out[: len(out) - lag]])
                out[:cut] = "unknown"
            except (ValueError, np.linalg.LinAlgError):
                pass
        return pdf[[*keys, fr.TIME]].assign(regime=out)

    f = model_features(bars, keys).select(*keys, fr.TIME, "close", *FEATURES)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, fr.TIME]) + ", regime string"
    return bars.join(f.groupBy(*keys).applyInPandas(run, schema), [*keys, fr.TIME])


def summary(df: DataFrame, returns: str, *, label: str = "regime", year: float = 105_120.0, least: int = 10, keys=fr.KEYS) -> DataFrame:
    """Share of bars, annual return, volatility and Sharpe ratio by label."""
    total = F.sum("bars").over(fr.whole(keys))
    g = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("bars"), F.avg(returns).alias("_m"), F.stddev_samp(returns).alias("_s"))
    g = g.withColumn("share", F.col("bars") / total).where(F.col("bars") >= least)
    ret, vol = F.col("_m") * year, F.col("_s") * F.lit(year**0.5)
    return g.select(*keys, label, "bars", "share", ret.alias("annual_return"), vol.alias("annual_vol"), F.coalesce(fr.divide(ret, F.when(vol > 1e-12, vol)), F.lit(0.0)).alias("sharpe"))
