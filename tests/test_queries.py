"""Every registered query against its SQL, on the smallest tables."""

import math
import os
from itertools import combinations

import duckdb
import numpy as np
import pytest

from sigmill import queries as engine

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(row):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)

    return tuple(map(one, row))


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_equals_sql(spark, duck, name):
    df = engine.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(plain(r) for r in df.select(*cols).collect())
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({engine.ORACLES[name]})").fetchall()
    assert got == sorted(map(plain, want))


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLES)))
def test_runs_without_sql(spark, name):
    assert engine.QUERIES[name](spark, SF).count() > 0


def test_pbo_of_all_instruments(spark):
    """Every candidate on every instrument, against splits tried one by one."""
    rows = engine.simple_path(spark, SF).select("candidate_id", "symbol", "open_time", "net_return").toPandas().sort_values("open_time")
    x = {f"{c}/{s}": g.net_return.to_numpy(float) for (c, s), g in rows.groupby(["candidate_id", "symbol"])}
    names = sorted(x)

    def sharpe(v):
        v = v[~np.isnan(v)]
        var = (np.sum(v**2) - np.sum(v) ** 2 / len(v)) / (len(v) - 1)
        return v.mean() / math.sqrt(var) if var > 1e-18 else 0.0

    poor = {k: [] for k in names}
    for train in [c for c in combinations(range(8), 4) if 0 in c]:
        score = {k: [sharpe(v[np.isin(np.minimum(7, np.arange(len(v)) * 8 // len(v)), train, invert=i)]) for i in (False, True)] for k, v in x.items()}
        best = min(names, key=lambda k: (-score[k][0], k))
        poor[best].append(sum(score[k][1] <= score[best][1] for k in names) / len(names) < 0.5)
    batch = sum(map(sum, poor.values())) / sum(map(len, poor.values()))
    want = {k: round(sum(p) / len(p) if len(p) >= 3 else batch, 6) for k, p in poor.items()}
    assert len({k.split("/")[1] for k in names}) == 5
    assert {r.candidate_id: r.pbo for r in engine.QUERIES["pbo_cscv"](spark, SF).collect()} == pytest.approx(want)
