import itertools
import random

import pytest

from sigmill.plans import expr as x


def test_precedence_and_errors():
    assert x.parse("$close + $open * 2") == x.call("+", x.leaf("$close"), x.call("*", x.leaf("$open"), x.number(2)))
    assert x.parse("-2 * $close").args[0] == x.number(-2)
    assert x.parse("$CLOSE") == x.leaf("$close")
    assert x.parse("not $close > $open").op == "GT"  # not binds tighter than a comparison
    for text, say in [
        ("close", "start with"), ("$close +", "end of input"), ("$close > $open > $low", "chain"), ("FOO($close)", "unknown operator"), ("TS_MEAN($close)", "exactly 2"),
        ("TS_MEAN($close, 7)", "window"), ("$close * 3", "grid"), ("$nope", "unknown leaf"), ("RANK($close)", "across"), ("$close ; $open", "character"), ("$close $open", "unexpected"), ("TS_MEAN($close, $open)", "constant"),
        ("$close * 2 + $open * 5 + $high * 10 + $low * 0.5", "at most"),
    ]:
        with pytest.raises(x.ExpressionError, match=say):
            x.parse(text)


def test_snap_and_categories():
    assert x.parse("$close * 2.04").args[1] == x.number(2)
    assert x.free_constants(x.parse("$regime_state == 3")) == 0
    assert x.free_constants(x.parse("TS_MEAN($close, 20) * 0.5")) == 1


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("$close - $open", "$close + -$open", True),
        ("$close * $open", "$open * $close", True),
        ("$close - $open", "$open - $close", False),
        ("not ($close > $open and $high > $low)", "not ($close > $open) or not ($high > $low)", True),
        ("TS_MEAN(-$close, 20)", "-TS_MEAN($close, 20)", True),
        ("TS_MAX(-$close, 20)", "-TS_MAX($close, 20)", False),
        ("$close * 0", "$open * 0", False),
        ("$close / $close", "$open / $open", False),
        ("TS_CORR($close, $open, 20)", "TS_CORR($open, $close, 20)", True),
        ("WHERE(not $close, $open, $high)", "WHERE($close, $high, $open)", True),
        ("ABS(-$close)", "ABS(ABS($close))", True),
        ("$close + (0.5 + 0.5)", "$close + 1", True),
    ],
)
def test_rewrites(a, b, same):
    assert (x.fingerprint(x.parse(a)) == x.fingerprint(x.parse(b))) is same


def generated(n=150):
    r = random.Random(3)

    def tree(d):
        if d == 0 or r.random() < 0.2:
            return r.choice([x.leaf("$close"), x.leaf("$open"), x.leaf("$volume"), x.number(r.choice([-1, 0, 1, 2]))])
        op = r.choice([*x.INFIX, "NEG", "ABS", "NOT", "AND", "OR", "GT", "LT", "WHERE", "TS_MEAN", "DELAY", "TS_CORR"])
        if op in ("TS_MEAN", "DELAY"):
            return x.call(op, tree(d - 1), x.number(5))
        if op == "TS_CORR":
            return x.call(op, tree(d - 1), tree(d - 1), x.number(20))
        return x.call(op, *[tree(d - 1) for _ in range(x.ARITY.get(op, 2))])

    return [tree(4) for _ in range(n)]


def test_canonical_form_is_a_fixed_point_and_renders():
    for t in generated():
        c = x.canonicalize(t)
        assert x.canonicalize(c) == c
        text = x.render(c)
        again = x._Parser(text, True).expression()
        assert x.canonicalize(again) == c, text


def test_measures():
    t = x.parse("TS_MEAN($close, 20) * 0.5 + $open")
    assert (x.depth(t), x.leaves(t), x.lookbacks(t)) == (3, {"$close", "$open"}, {20})
    assert x.complexity(t) == 2 * 3 + 3 + 2 + 1 + 1
    assert x.consistent(t, ["price"])[0] and not x.consistent(t, ["funding"])[0]


def test_evaluation_matches_pandas_and_ignores_the_future(spark):
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(1)
    n = 120
    close = 100 * np.exp(np.cumsum(r.normal(0, 0.01, n)))
    pdf = pd.DataFrame({"symbol": "A", "open_time": np.arange(n) * 1000, "open": close * 0.99, "high": close * 1.01, "low": close * 0.98, "close": close, "volume": r.lognormal(size=n)})
    trees = {f"t{i}": x.canonicalize(x.parse(t)) for i, t in enumerate(["TS_ZSCORE(DELTA($close, 1), 20)", "TS_RANK($close, 10)", "TS_CORR($close, $volume, 20)", "$returns", "TS_STD($close, 20) / 0", "LOG($open - $close)"])}
    got = x.evaluate(spark.createDataFrame(pdf), trees).orderBy("open_time").toPandas()
    d = pdf.close.diff()
    want = [
        (d - d.rolling(20).mean()) / d.rolling(20).std(),
        pdf.close.rolling(10).apply(lambda v: ((v <= v[-1]).sum() - 1) / 9, raw=True),
        pdf.close.rolling(20).corr(pdf.volume),
        np.log(pdf.close / pdf.close.shift()),
    ]
    for i, w in enumerate(want):
        np.testing.assert_allclose(got[f"t{i}"].to_numpy(float), w.to_numpy(float), rtol=1e-9, atol=1e-12)
    assert got["t4"].isna().all() and got["t5"].isna().all()
    cut = x.evaluate(spark.createDataFrame(pdf.iloc[:80]), trees).orderBy("open_time").toPandas()
    for c in trees:
        np.testing.assert_allclose(cut[c].to_numpy(float), got[c].to_numpy(float)[:80], rtol=1e-9, atol=1e-12)


def test_missing_values(spark):
    df = spark.createDataFrame([("A", 1, 1.0, None), ("A", 2, None, 2.0), ("A", 3, 0.0, 0.0)], "symbol string, open_time long, close double, open double")
    got = x.evaluate(df, {k: x.parse(t) for k, t in {"gt": "$close > $open", "no": "not $close", "or_": "$close or $open", "div": "$open / $close", "w": "WHERE($close, 1, -1)"}.items()}).orderBy("open_time").collect()
    assert [(r.gt, r.no, r.or_, r.div, r.w) for r in got] == [(0.0, 0.0, 1.0, None, 1.0), (0.0, 1.0, 1.0, None, -1.0), (0.0, 1.0, 0.0, None, -1.0)]
    with pytest.raises(x.ExpressionError, match="lack"):
        x.evaluate(df, {"v": x.parse("$volume")})


def test_shared_windows_are_computed_once(spark):
    df = spark.createDataFrame([("A", i, float(i)) for i in range(9)], "symbol string, open_time long, close double")
    trees = {"a": x.parse("TS_MEAN($close, 5) + 1"), "b": x.parse("TS_MEAN($close, 5) * 2"), "c": x.parse("DELTA(TS_MEAN($close, 5), 1)")}
    plan = x.evaluate(df, trees)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.count("avg(") for line in plan.splitlines() if "Window" in line) == 1, plan
    assert list(itertools.islice(x.walk(trees["a"]), 1))
