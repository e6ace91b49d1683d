"""Toxicity by a classifier chain of linear models."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import documents, materialize, struct_of
from .features import NAMES, Scale, dense, sigmoid, tokens


#: Words that a worker remembers the places of.
_MEMO = 1 << 18


def word_features(word: bytes) -> list[int]:
    """Hashes (signed) of a word and of its first 3 to 8 characters."""
    text = word.decode()
    parts = [word, *[b"^" + text[:k].encode() for k in range(3, 9) if len(text) > k]]
    return [xxhash.xxh3_64_intdigest(p) - (1 << 63) for p in parts]


class Linear:
    """Logistic regression with weight decay, fitted by full passes with Adam."""

    def __init__(self, columns: int):
        self.weight, self.bias = np.zeros(columns, np.float32), 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.weight).astype(float) + self.bias

    def fit(self, x: np.ndarray, y: np.ndarray, passes: int = 120, decay: float = 1e-4, rate: float = 0.1) -> Linear:
        n = len(y)
        if not n:
            return self
        theta = np.zeros(x.shape[1] + 1)
        theta[-1] = np.log((y.sum() + 1) / (n - y.sum() + 1))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, passes + 1):
            err = (sigmoid(x @ theta[:-1].astype(np.float32) + theta[-1]) - y) / n
            grad = np.append(x.T @ err.astype(np.float32), err.sum())
            grad[:-1] += decay * theta[:-1]
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta - rate * (1 - k / (passes + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        self.weight, self.bias = theta[:-1].astype(np.float32), float(theta[-1])
        return self


class Chain:
    """One linear model a category, in order; each also sees the probabilities of those before it.

    For fitting, these come from models that have not seen the document: the
    rows are dealt to ``folds``, and a fold's probabilities are predicted by a
    model of the other folds. Those of the last category set ``cut``: the
    lowest at which a share of ``clean`` of the rows without it stay below.
    """

    def __init__(self, categories: list[str], places: dict[int, int], clean: float):
        self.categories, self.places, self.clean = categories, places, clean
        self.models: list[Linear] = []
        self.scale, self.cut = Scale(np.zeros((0, len(NAMES)))), 0.5
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def fit(self, found: np.ndarray, measures: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int) -> Chain:
        self.scale = Scale(measures)
        x = self._columns(found, measures)
        for c in range(len(self.categories)):
            self.models.append(Linear(x.shape[1]).fit(x, y[:, c]))
            out = np.zeros(len(y))
            for k in range(folds):
                held, rest = fold == k, fold != k
                out[held] = sigmoid(Linear(x.shape[1]).fit(x[rest], y[rest, c]).margin(x[held]))
            x = self._linked(x, out)
        last = y[:, -1] > 0 if len(y) else np.zeros(0, bool)
        if last.any() and not last.all():
            self.cut = float(min(0.5, np.quantile(out[~last], self.clean, method="higher")))
        return self

    def _columns(self, found: np.ndarray, measures: np.ndarray) -> np.ndarray:
        return np.hstack([found, self.scale(measures).astype(np.float32)])

    @staticmethod
    def _linked(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.column_stack([x, (2 * p - 1).astype(np.float32)])

    def counted(self, text: str | None) -> tuple[dict[int, float], int]:
        """What share of a text's words has each known feature (log of 1 + per cent)."""
        memo, places, acc, n = self.memo, self.places, {}, 0
        for word, many in Counter(tokens(text)).items():
            at = memo.get(word)
            if at is None:
                if len(memo) >= _MEMO:
                    memo.clear()
                at = memo[word] = tuple(places[f] for f in word_features(word) if f in places)
            n += many
            for i in at:
                acc[i] = acc.get(i, 0) + many
        return {i: min(3.0, math.log1p(100 * k / n)) for i, k in acc.items()}, n

    def predict(self, texts: list[str | None]) -> np.ndarray:
        found = np.zeros((len(texts), len(self.places)), np.float32)
        for row, text in zip(found, texts):
            for i, value in self.counted(text)[0].items():
                row[i] = value
        x, out = self._columns(found, np.array([dense(t) for t in texts]).reshape(len(texts), len(NAMES))), []
        for model in self.models:
            out.append(sigmoid(model.margin(x)))
            x = self._linked(x, out[-1])
        return np.array(out).T.reshape(len(texts), len(self.models))


def telling(counts: DataFrame, totals: list[float], n: float, most: int) -> list[int]:
    """The features that tell a category best: ``most`` at most for each, by G squared.

    ``counts``: f, n (documents that hold it) and c0.. (those of each category).
    """
    chosen: set[int] = set()
    share = F.col("n") / F.lit(n)
    for c, total in enumerate(totals):
        if not 0 < total < n:
            continue
        cells = [(F.col(f"c{c}"), total, share), (F.col("n") - F.col(f"c{c}"), n - total, share), (total - F.col(f"c{c}"), total, 1 - share), (n - total - F.col("n") + F.col(f"c{c}"), n - total, 1 - share)]
        g = sum((F.when(a > 0, a * F.ln(a / (F.lit(t) * s))).otherwise(0.0) for a, t, s in cells), F.lit(0.0))
        best = counts.select("f", g.alias("g")).where(F.col("g") > 4).orderBy(F.col("g").desc(), "f").limit(most).collect()
        chosen |= {r["f"] for r in best}
    return sorted(chosen)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], *, sample: int, features: int, least: int, folds: int, clean: float, seed: int) -> Chain:
    """Fit a chain on ``sample`` labelled documents at most (least seeded hashes first).

    ``labels``: doc_id and a 0/1 column for each category. Every word of the
    sampled texts gives hashed features; those that at least ``least``
    documents hold compete by G squared for ``features`` places a category.
    Only bounded things reach the driver: the chosen hashes, and each sampled
    document's values at them.
    """
    known = labels.dropna(subset=["doc_id", *categories]).groupBy("doc_id").agg(F.array(*[F.max(c).cast("double") for c in categories]).alias("y"))
    chosen = materialize(known.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).orderBy("h", "doc_id").limit(sample), "toxicity-sample")
    text = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "toxicity-texts")
    names = ["f", "n", *[f"c{i}" for i in range(len(categories))]]

    def summed(held: list, marks: list) -> pa.RecordBatch:
        f, at = np.unique(np.concatenate(held), return_inverse=True)
        y = np.repeat(np.array(marks), [len(h) for h in held], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(f), pa.array(np.bincount(at)), *[pa.array(np.bincount(at, y[:, c])) for c in range(y.shape[1])]], names)

    def document_counts(batches):
        held, marks, size = [], [], 0
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                some = {f for w in set(tokens(t)) for f in word_features(w)}
                if some:
                    held.append(np.fromiter(some, np.int64, len(some)))
                    marks.append(y)
                    size += len(some)
                if size > 1 << 21:
                    yield summed(held, marks)
                    held, marks, size = [], [], 0
        if held:
            yield summed(held, marks)

    parts = text.select("text", "y").mapInArrow(document_counts, "f long, n long, " + ", ".join(f"c{i} double" for i in range(len(categories))))
    counts = parts.groupBy("f").agg(*[F.sum(c).alias(c) for c in names[1:]]).where(F.col("n") >= least)
    counts = materialize(counts, "toxicity-counts")
    of = text.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.col("y")[i]), F.lit(0.0)) for i in range(len(categories))]).first()
    best = telling(counts, [float(x) for x in of[1:]], float(of["n"]), features)
    chain = Chain(categories, {f: i for i, f in enumerate(best)}, clean)

    def placed(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            some = [sorted(chain.counted(t)[0].items()) for t in texts]
            columns = [pa.array([[i for i, _ in s] for s in some], pa.list_(pa.int32())), pa.array([[v for _, v in s] for s in some], pa.list_(pa.float64())), pa.array([dense(t) for t in texts], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), *columns], ["h", "doc_id", "y", "i", "v", "x"])

    got = text.select("text", "h", "doc_id", "y").mapInArrow(placed, "h long, doc_id long, y array<double>, i array<int>, v array<double>, x array<double>").orderBy("h", "doc_id").collect()
    found = np.zeros((len(got), len(best)), np.float32)
    for row, r in zip(found, got):
        row[np.array(r["i"], np.int64)] = r["v"]
    measures = np.array([r["x"] for r in got]).reshape(len(got), len(NAMES))
    return chain.fit(found, measures, np.array([r["y"] for r in got]).reshape(len(got), len(categories)), np.arange(len(got)) % folds, folds)


def toxicity(docs: DataFrame, labels: DataFrame, *, categories: tuple[str, ...] = ("low_quality", "toxic"), clean: float = 0.995, sample: int = 6000, features: int = 512, least: int = 3, folds: int = 3, seed: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Category probabilities of every whole text; the last category decides.

    ``docs`` needs doc_id and text; columns in ``keep`` are carried through, of
    any name but those of the results. A text is toxic if the probability of
    the last category is above a cut learned from out-of-fold probabilities:
    a share of ``clean`` of the labelled documents without it stay below (it
    is a half at most). Nulls: a null text has no words; labels with a null
    are not learned from; a null doc_id is scored like any other. Repeated
    rows are scored alike; of rows that share a labelled doc_id one is learned
    from. Without labels every probability is a half and nothing is toxic.
    Empty input gives no rows. Texts are read whole, however long.

    Returns ``keep``, p_<category> for each, and toxic_flag (boolean).
    """
    known = docs.sparkSession.sparkContext.broadcast(train(docs, labels, list(categories), sample=sample, features=features, least=least, folds=folds, clean=clean, seed=seed))
    fields = [f for f in docs.schema.fields if f.name in keep]
    results = [*[f"p_{c}" for c in categories], "toxic_flag"]
    if clash := {f.name for f in fields} & set(results):
        raise ValueError(f"columns to keep clash with results: {clash}")

    def run(batches):
        model = known.value
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo in range(0, len(texts), 512):
                p = model.predict(texts[lo : lo + 512])
                kept = b.column(0).slice(lo, 512)
                yield pa.RecordBatch.from_arrays([kept.field(f.name) for f in fields] + [pa.array(p[:, i]) for i in range(p.shape[1])] + [pa.array(p[:, -1] > model.cut)], [*[f.name for f in fields], *results])

    schema = StructType([*fields, *[StructField(f"p_{c}", DoubleType()) for c in categories], StructField("toxic_flag", BooleanType())])
    return docs.select(struct_of([f.name for f in fields]).alias("_kept"), F.col("text").alias("_text")).mapInArrow(run, schema)


def chain_labels(labels: DataFrame) -> DataFrame:
    """The two categories that the labels table can give, the easier one first."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic").alias("toxic"))


def op7_toxicity(spark, sf_dir):
    return toxicity(documents(spark, sf_dir), chain_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
