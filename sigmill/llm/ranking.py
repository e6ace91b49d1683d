"""Quality scores by Bradley-Terry pairwise ranking.

Learned from are all pairs of a labelled 1 and a labelled 0 row. Pairs are not
laid out: the loss and its derivatives depend on rows by their scores, so rows
are summed by class and narrow range of the score, and ranges meet in pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, quantiles, split_by_keys
from .features import NAMES, Scale, dense, sigmoid


class Ranker:
    """Linear scores from preference pairs, and a threshold at a quantile of them.

    The chance that i is preferred to j is logistic in the difference of their
    scores. ``score`` maps a score to 0..1 so that the quantile falls on ``cut``.
    """

    def __init__(self, cut: float):
        self.cut = cut
        self.weight, self.middle, self.unit = np.zeros(len(NAMES)), 0.0, 1.0
        self.scale = Scale(np.zeros((0, len(NAMES))))

    def fit(self, x: np.ndarray, y: np.ndarray, pairs: int, seed: int, decay: float = 1e-2) -> Ranker:
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.scale = Scale(x)
        if not len(good) or not len(bad):
            self.middle = -1.0 if len(good) else 0.0
            return self
        z, r = self.scale(x), np.random.default_rng(seed)
        d = z[r.choice(good, pairs)] - z[r.choice(bad, pairs)]

        def slopes(w):
            p = sigmoid(d @ w)
            return d.T @ (p - 1) / pairs, (d * (p * (1 - p))[:, None]).T @ d / pairs

        self.weight = optimum(slopes, z.shape[1], decay, 1e-8)
        s = z @ self.weight
        below = len(bad) / len(y)
        return self.place(*np.quantile(s, [max(0.0, below - 0.01), min(1.0, below + 0.01)]), np.median(s[good]), np.median(s[bad]))

    def place(self, low: float, high: float, good: float, bad: float) -> Ranker:
        """The threshold at the quantile that leaves as large a share below it as label 0 has; ``good`` and ``bad``: medians."""
        self.middle = float((low + high) / 2)
        self.unit = max(1e-6, float(good - bad) / 8)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        s = self.scale(x) @ self.weight
        return sigmoid((s - self.middle) / self.unit + np.log(self.cut / (1 - self.cut)))


def optimum(slopes, size: int, decay: float, enough: float) -> np.ndarray:
    """Newton steps on the mean logistic loss; ``slopes`` gives its gradient and Hessian at the weights."""
    w = np.zeros(size)
    for _ in range(25):
        g, h = slopes(w)
        step = np.linalg.solve(h + decay * np.eye(size), g + decay * w)
        w = w - step
        if np.abs(step).max() < enough:
            break
    return w


#: Scores are summed in ranges of this width; each range counts at its mean score.
WIDTH = 1 / 64
_UPPER = np.triu_indices(len(NAMES))


def range_sums(z: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the scores, and of the rows of each the number, the sum and the sum of products."""
    order = np.argsort(at := np.floor(s / WIDTH).astype(np.int64), kind="stable")
    at, z = at[order], z[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], np.add.reduceat(np.column_stack([np.ones(len(z)), z, z[:, _UPPER[0]] * z[:, _UPPER[1]]]), first)


def all_pairs(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian at ``w`` of the mean loss over all pairs of rows, of their range sums."""
    m = len(w)
    n, b = good[:, 0], bad[:, 0]
    zg, zb = good[:, 1 : m + 1], bad[:, 1 : m + 1]
    p = sigmoid((zg @ w / n)[:, None] - (zb @ w / b)[None, :])
    miss, v = p - 1, p * (1 - p)
    g = zg.T @ (miss @ b) - zb.T @ (n @ miss)
    square = np.zeros((m, m))
    square[_UPPER] = good[:, m + 1 :].T @ (v @ b) + bad[:, m + 1 :].T @ (n @ v)
    square = square + square.T - np.diag(np.diag(square))
    cross = zg.T @ v @ zb
    pairs = n.sum() * b.sum()
    return g / pairs, (square - cross - cross.T) / pairs


def train(docs: DataFrame, labels: DataFrame, *, cut: float, decay: float = 1e-2) -> Ranker:
    """Learned from all rows of ``labels`` (doc_id and quality) whose text is in ``docs``; one row counts for a doc_id."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") == 1).cast("int").alias("quality"))
    known = materialize(known, "ranking-labels")

    def measured(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([dense(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])

    some = split_by_keys(docs.select("doc_id", "text"), known, "doc_id")[0].mapInArrow(measured, "doc_id long, x array<double>")
    rows = materialize(some.join(known, "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("x").alias("x")).select("quality", "x"), "ranking-known")
    model = Ranker(cut)
    each = [F.get("x", F.lit(i)) for i in range(len(NAMES))]
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.array(*map(F.avg, each)).alias("mean"), F.array(*map(F.stddev_pop, each)).alias("spread")).first()
    n, good = total["n"], total["good"]
    if n:
        model.scale.mean, model.scale.spread = np.array(total["mean"]), np.maximum(np.array(total["spread"]), 1e-3)
    if good in (0, n):
        model.middle = -1.0 if good else 0.0
        return model
    scale = model.scale

    def slopes(w):
        def run(batches):
            for b in batches:
                x, y = b.column(1).flatten().to_numpy().reshape(b.num_rows, len(NAMES)), b.column(0).to_numpy()
                for kind in (0, 1):
                    z = scale(x[y == kind])
                    if len(z):
                        at, sums = range_sums(z, z @ w)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(list(sums), pa.list_(pa.float64()))], ["quality", "at", "sums"])

        width = 1 + len(NAMES) + len(_UPPER[0])
        ranges = rows.mapInArrow(run, "quality int, at long, sums array<double>").groupBy("quality", "at").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
        got = sorted(ranges.collect(), key=lambda r: (r["quality"], r["at"]))
        return all_pairs(*(np.array([r["sums"] for r in got if r["quality"] == kind]) for kind in (1, 0)), w)

    model.weight = optimum(slopes, len(NAMES), decay, 1e-6)

    def placed(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scale(x) @ model.weight)], ["quality", "s"])

    s = materialize(rows.mapInArrow(placed, "quality int, s double"), "ranking-scores")
    below = 1 - good / n
    return model.place(*quantiles(s, "s", [below - 0.01, below + 0.01]), *(quantiles(s.where(F.col("quality") == kind), "s", [0.5])[0] for kind in (1, 0)))


def rank_quality(docs: DataFrame, labels: DataFrame, *, cut: float = 0.7) -> DataFrame:
    """Score of every whole text, 0 to 1, and whether it reaches ``cut``; learned from all labelled rows and all their pairs.

    Nulls: a null text is empty and has all measures 0; a null doc_id is
    scored like any other; labels with a null are not learned from. Repeated
    rows are scored alike. Without labels of both kinds all texts get one
    score. Empty input gives no rows. Other columns are not looked at.

    Returns doc_id, score, predicted.
    """
    known = docs.sparkSession.sparkContext.broadcast(train(docs, labels, cut=cut))

    def run(batches):
        model = known.value
        for b in batches:
            x = np.array([dense(t) for t in b.column(1).to_pylist()]).reshape(b.num_rows, len(NAMES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def op9_ranking(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = rank_quality(documents(spark, sf_dir), labels)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
