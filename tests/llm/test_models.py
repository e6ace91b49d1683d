import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.llm import common, quality_rules, ranking, topk, toxicity
from sigmill.llm.features import NAMES, dense

from . import brute

BAD = ["awful", "nasty", "vile"]


def corpus(seed=1, n=500):
    """doc_id, text, quality, toxic"""
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(700)]
    out = []
    for i in range(n):
        w = [r.choice(pool) for _ in range(r.randint(60, 200))]
        good, mean = r.random() > 0.2, r.random() < 0.2
        if not good:
            w = [x + r.choice(["%%%", "###"]) for x in w] if r.random() < 0.5 else [y for x in w[:40] for y in [x] * 15]
        if mean:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(BAD) + r.choice(["", ".", "!"]))
        out.append((i, " ".join(w), int(good), int(mean)))
    return out


def frames(spark, rows, upto):
    docs = spark.createDataFrame([(k, t, "z") for k, t, *_ in rows] + [(None, None, None), (9_000_000, "", "z"), (9_000_001, "one", "z")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, q, x) for k, _, q, x in rows[:upto]] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity_on_held_out(spark):
    rows = corpus()
    docs, labels = frames(spark, rows, 350)
    got = {x.doc_id: x for x in toxicity.toxicity(docs, toxicity.chain_labels(labels), least=2, keep=("doc_id", "lang")).collect()}
    assert len(got) == len(rows) + 3 and not got[None].toxic_flag and got[5].lang == "z"
    wrong = sum(got[k].toxic_flag != bool(x) for k, _, _, x in rows[350:])
    assert wrong <= 9  # of 150, learned from 350
    assert 0 <= got[None].p_low_quality <= 1
    none = toxicity.toxicity(docs, toxicity.chain_labels(labels.where("doc_id = -1")))
    assert none.where("toxic_flag").count() == 0
    assert toxicity.toxicity(docs.where("doc_id = -1"), toxicity.chain_labels(labels)).count() == 0
    with pytest.raises(ValueError):
        toxicity.toxicity(docs.withColumn("toxic_flag", F.lit(1)), toxicity.chain_labels(labels), keep=("doc_id", "toxic_flag"))


def test_chain_uses_out_of_fold_probabilities():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, len(NAMES)))
    y = np.column_stack([(x[:, 0] > 0), (x[:, 0] + x[:, 1] > 0)]).astype(float)
    fold = np.arange(300) % 3
    chain = toxicity.Chain(["a", "b"], {}, 0.99).fit(np.zeros((300, 0), np.float32), x, y, fold, 3)
    assert [len(m.weight) for m in chain.models] == [len(NAMES), len(NAMES) + 1]

    def plain(z, target):  # out-of-fold probabilities by models of the other folds
        out = np.zeros(300)
        for k in range(3):
            model = toxicity.Linear(z.shape[1]).fit(z[fold != k], target[fold != k])
            out[fold == k] = 1 / (1 + np.exp(-(z[fold == k] @ model.weight + model.bias)))
        return out

    z = np.clip((x - x.mean(0)) / x.std(0), -5, 5).astype(np.float32)
    first = plain(z, y[:, 0])
    linked = np.column_stack([z, 2 * first - 1]).astype(np.float32)
    second = toxicity.Linear(linked.shape[1]).fit(linked, y[:, 1])
    assert np.allclose(second.weight, chain.models[1].weight, atol=1e-3)
    last = plain(linked, y[:, 1])
    assert chain.cut <= 0.5 and (chain.cut == 0.5 or (last[y[:, 1] == 0] <= chain.cut + 1e-3).mean() >= 0.985)


def test_words_with_junk_and_new_endings_are_found(spark):
    """A stem that only ever comes with other endings, and words with symbols at their ends."""
    r = random.Random(6)
    clean = lambda: ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(r.randint(40, 120))]
    rows = []
    for i in range(600):
        w, mean = clean(), i % 5 == 0
        for _ in range(3 if mean else 0):
            w.insert(r.randrange(len(w)), r.choice(["zwor" + "".join(r.choice("abcdef") for _ in range(5)), "Vile%%%", "VILE!", "vile,"]))
        rows.append((i, " ".join(w), 0, int(mean)))
    docs = spark.createDataFrame([(k, t) for k, t, *_ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q, x) for k, _, q, x in rows[:400]], "doc_id long, low int, toxic int")
    flagged = {x.doc_id for x in toxicity.toxicity(docs, labels, categories=("low", "toxic")).where("toxic_flag").collect()}
    assert len(flagged & set(range(400, 600, 5))) >= 38 and len([k for k in flagged if k >= 400 and k % 5]) <= 3


def test_features_that_tell():
    assert len(toxicity.word_features(b"abcdefghij")) == 7 and len(toxicity.word_features("äöü".encode())) == 1
    assert toxicity.word_features(b"worthless")[1] == toxicity.word_features(b"worm")[1]


def test_ranking_on_held_out(spark):
    rows = corpus(2)
    docs, labels = frames(spark, rows, 350)
    got = {x.doc_id: x for x in ranking.rank_quality(docs, labels).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got.values())
    assert sum(got[k].predicted != q for k, _, q, _ in rows[350:]) <= 5
    one = ranking.rank_quality(docs, labels.where("quality = 1"))
    assert one.select("score").distinct().count() == 1
    assert dense(None) == [0.0] * len(NAMES) == dense(" \n")


def test_scores_are_the_optimum_over_the_pairs():
    """The weights against plain gradient descent on the logistic loss of feature differences."""
    r = np.random.default_rng(5)
    x = r.normal(size=(80, len(NAMES)))
    y = (x[:, 0] - 0.5 * x[:, 3] + r.normal(size=80) > 0).astype(int)
    model = ranking.Ranker(0.7).fit(x, y, 500, 9)
    z, draw = np.clip((x - x.mean(0)) / x.std(0), -5, 5), np.random.default_rng(9)
    d = z[draw.choice(np.flatnonzero(y == 1), 500)] - z[draw.choice(np.flatnonzero(y == 0), 500)]
    w = np.zeros(len(NAMES))
    for _ in range(6000):
        w -= 0.3 * (d.T @ (1 / (1 + np.exp(-d @ w)) - 1) / 500 + 1e-2 * w)
    assert np.allclose(w, model.weight, atol=1e-4)
    s = z @ w
    low = np.quantile(s, [(y == 0).mean() - 0.01, (y == 0).mean() + 0.01]).mean()
    assert model.middle == pytest.approx(low, abs=1e-3)
    assert np.allclose(model.score(x) >= 0.7, s >= model.middle)


def test_all_labels_and_all_their_pairs_count(spark):
    """Derivatives of range sums against all pairs laid out; 8,100 labels of which the last 100 alone tell more."""
    r = np.random.default_rng(6)
    z, w = r.normal(size=(90, len(NAMES))), r.normal(size=len(NAMES)) / 2
    good, bad = z[:40], z[40:]
    d = (good[:, None] - bad[None]).reshape(-1, len(NAMES))
    p = 1 / (1 + np.exp(-d @ w))
    g, h = ranking.all_pairs(*(ranking.range_sums(x, x @ w)[1] for x in (good, bad)), w)
    assert np.allclose(g, d.T @ (p - 1) / len(d), atol=1e-4) and np.allclose(h, (d * (p * (1 - p))[:, None]).T @ d / len(d), atol=1e-4)
    ids = [x.id for x in spark.range(8100).orderBy(F.xxhash64(F.lit(9), "id"), "id").collect()]
    rows = [(k, "good words. and more" if i % 2 else "bad 12 %% words ", i % 2) for i, k in enumerate(ids[:8000])] + [(k, "odd! odd! odd! odd!", 0) for k in ids[8000:]]
    docs, labels = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id long, quality int")
    model = ranking.train(docs, labels, cut=0.7)
    assert model.scale.mean[NAMES.index("exclaim")] == pytest.approx(100 / 8100)
    assert model.score(np.array([dense("odd! odd! odd! odd!")]))[0] < 0.7 < model.score(np.array([dense("good words. and more")]))[0]


def test_all_trusted_texts_count(spark):
    """20,200 labelled texts, of which the first 20,000 by hash share one word, and the others have another."""
    ids = [x.id for x in spark.range(20_200).orderBy(F.xxhash64(F.lit(5), "id"), "id").collect()]
    text = lambda i: "common" if i < 20_000 else "late"
    docs = spark.createDataFrame([(k, text(i)) for i, k in enumerate(ids)] + [(-1, "never")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in ids], "doc_id long, quality int")
    got = {x.doc_id: x.score for x in quality_rules.judge(docs, labels).where(f"doc_id in (-1, {ids[0]}, {ids[-1]})").collect()}
    assert got[ids[0]] > got[ids[-1]] > got[-1] and abs(got[ids[-1]] - got[ids[0]]) < 0.5


def test_quantiles_by_ranges(spark):
    r = np.random.default_rng(1)
    for x in (r.normal(size=3000), np.round(r.normal(size=3000), 1), np.array([2.0]), np.append(r.normal(size=500) * 1e-9, 1e12)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        shares = [0.0, 0.013, 0.5, 0.977, 1.0]
        assert np.allclose(common.quantiles(df, "x", shares, most=5, bins=16), np.quantile(x, shares), rtol=1e-12)
        assert common.quantiles(df.where("x is null"), "x", shares) is None


def test_quality_rules(spark):
    rows = corpus(3, 250)
    docs, labels = frames(spark, rows, 150)
    got = quality_rules.judge(docs, labels).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(rows) + 3
    texts = {k: t for k, t, *_ in rows} | {None: None, 9_000_000: "", 9_000_001: "one"}
    for k, t in texts.items():
        w = [x.decode() for x in brute.words(t)]
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        x = by[k]
        n = brute.repeat_words(w)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), n)
        assert x.base_failed == (len(w) < 50 or 100 * n > 50 * len(w)) and not (x.base_failed and x.kept)
    wrong = [k for k, _, q, _ in rows if by[k].kept != (bool(q) and not by[k].base_failed)]
    assert len(wrong) <= 12  # of 250, learned from 90 and a threshold set by 30
    assert quality_rules.judge(docs.where("doc_id = -1"), labels).count() == 0
    none = quality_rules.judge(docs, labels.where("doc_id = -1"))
    assert none.where("score <> 0").count() == 0


def test_scores_equal_a_plain_count(spark):
    rows = corpus(4, 60)
    docs, labels = frames(spark, rows, 40)
    got = {x.doc_id: x for x in quality_rules.judge(docs, labels, buckets=64, trusted=25, lost=0.2).collect()}
    ids = spark.createDataFrame([(k,) for k, *_ in rows[:40] if rows[k][2] == 1], "doc_id long").withColumn("h", F.xxhash64(F.lit(5), "doc_id"))
    top = {x.doc_id: x.h % 4 == 0 for x in ids.orderBy("h", "doc_id").limit(25).collect()}
    words = [(k, i, w.decode()) for k, t, *_ in rows for i, w in enumerate(brute.words(t))] + [(9_000_001, 0, "one")]
    df = spark.createDataFrame(words, "k long, i int, w string")
    b = df.select("k", "i", F.pmod(F.xxhash64("w"), F.lit(64)).alias("b1"), "w")
    pairs = b.alias("a").join(b.alias("c"), (F.col("a.k") == F.col("c.k")) & (F.col("c.i") == F.col("a.i") + 1)).select(F.col("a.k").alias("k"), F.pmod(F.xxhash64("a.w", "c.w"), F.lit(64)).alias("b1"))
    grams = [(x.k, x.b1) for x in b.select("k", "b1").unionAll(pairs).collect()]
    raw, good = np.ones(64), np.ones(64)
    for k, g in grams:
        raw[g] += 1
        good[g] += not top.get(k, True)
    ratio = np.log(good / good.sum() / (raw / raw.sum()))
    score = {k: np.mean([ratio[g] for j, g in grams if j == k]) for k, *_ in rows}
    assert all(got[k].score == pytest.approx(score[k]) for k in score)
    least = np.quantile([score[k] for k, aside in top.items() if aside], 0.2)
    assert sum(top.values()) > 2 and any(not x.kept and not x.base_failed for x in got.values())
    assert all(got[k].kept == (not got[k].base_failed and score[k] >= least - 1e-12) for k in score)


def test_repeats_with_few_and_many(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("abc") for _ in range(n)) for n in (0, 1, 2, 3, 4, 50, 400)] + [" ".join(str(i % 90) for i in range(200)), "a a a a", " ".join(map(str, range(80)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_w", quality_rules.words())
    got = quality_rules.with_repeats(df, "_w", 3, "n").orderBy("doc_id").collect()
    assert [x.n for x in got] == [brute.repeat_words(t.split()) for t in texts]


def vectors(seed, n=400, d=9):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, d)) / 3
    v[50:60] = v[100]
    rows = [(i, [float(np.float32(x)) for x in v[i]]) for i in range(n)]
    return rows + [(n, None), (n + 1, [None] * d), (n + 2, [float("nan")] * d), (n + 3, [float("inf")] * d), (None, rows[0][1]), rows[0], (n + 50, rows[0][1][:4])]


@pytest.mark.parametrize("how", [{}, {"block": 64}, {"block": 32, "rows_a_task": 100, "queries_a_task": 7}])
def test_top_k_is_exact(spark, how):
    rows = vectors(1)
    df = spark.createDataFrame([(*x, 0, 0) for x in rows], "vec_id long, embedding array<float>, rank int, row int")
    got = sorted(tuple(x) for x in topk.search(df, every=20, k=5, **how).collect())
    q = [(k, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for k, v in rows if k is not None and v is not None and None not in v and np.isfinite(v).all()]
    q = [(k, np.pad(v, (0, 9 - len(v)))) for k, v in q]
    want = []
    for i, (a, x) in enumerate(q):
        if a % 20 == 0:
            best = sorted((-int(x @ y), b) for j, (b, y) in enumerate(q) if i != j)[:5]
            want += [(a, r + 1, b, -s) for r, (s, b) in enumerate(best)]
    assert sum(a == 0 for a, *_ in want) == 10  # a repeated row is a query and a candidate of its own
    assert got == sorted(want)


def test_top_k_with_long_tails_and_negatives():
    """Scores of all signs and sizes over many blocks, where earlier blocks bound later ones."""
    r = np.random.default_rng(4)
    for scale in (1, 3, 500, 40_000):
        v = np.rint(r.standard_t(2, (700, 5)) * scale).astype(np.int64)
        v[:300] -= 7 * scale
        rows, ids = np.arange(700), r.permutation(700) // 2
        got = topk.top_k(rows[::9], v[::9], rows, ids, v, 4, block=50, batch=8)
        want = []
        for i in range(0, 700, 9):
            s = v @ v[i]
            want += [(i, b, -a) for a, b in sorted((-int(s[j]), int(ids[j])) for j in range(700) if j != i)[:4]]
        assert got == want


def test_top_k_of_too_large_components(spark):
    df = spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        topk.search(df)


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (7, [0.5, -1.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in topk.search(df).collect()] == [(0, 1, 7, 256 * 128 - 512 * 256)]
    assert topk.search(df.where("vec_id < 0")).count() == 0
    same = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(120)], "vec_id long, embedding array<float>")
    assert [x.vec_id for x in topk.search(same).where("query_id = 50").orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_quality_rules_moves_no_texts(spark):
    """Labelled texts are learned from where they lie; what is shuffled or kept between is far below their size."""
    import os

    docs = spark.range(0, 400, 1, 4).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 300), i -> md5(string(id * 1000 + i))), ' ')").alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    base = common.scratch_dir(spark).removeprefix("file://")
    sizes = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, some in os.walk(base) for f in some)
    before = sizes()
    got = quality_rules.judge(docs, labels)
    assert got.count() == 400 and sizes() - before < 400 * 300 * 33 / 4
