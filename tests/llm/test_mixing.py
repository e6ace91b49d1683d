import math
import random
import re

import pytest

from sigmill.llm.mixing import apportion, draw, mix_sources

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def level_targets(size, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, done = share * sum(size.values()), {}
    while True:
        free = [s for s in names if s not in done]
        left = total - sum(done.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > most * size[s]]
        if not over:
            return done | t
        done |= {s: most * size[s] for s in over}


def documents(spark, seed=1, n=900):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randint(1, 4) for _ in range(min(2000, int(r.expovariate(1 / 60))))), r.choice(["a", "a", "a", "b", "ü", "Z", None])) for i in range(n)]
    rows += [(n, None, "a"), (n + 1, "", "empty"), (None, "x y z", "b"), rows[0], rows[0]]
    return rows, spark.createDataFrame([(*x, "q") for x in rows], "doc_id long, text string, source string, size string")


@pytest.mark.parametrize("shard", [1 << 17, 3000])
def test_targets_and_takes(spark, shard):
    rows, df = documents(spark)
    got = mix_sources(df, block_words=16, shard_words=shard).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    want = level_targets(size)
    for s in size:
        mine = [x for x in got if x.source == s]
        assert all(x.source_size == size[s] and math.isclose(x.target, want[s], rel_tol=1e-9, abs_tol=1e-9) for x in mine)
        assert abs(sum(x.taken for x in mine) - want[s]) <= max(40 * (1 + size[s] // shard), 0.005 * want[s])
    assert all(0 <= x.taken <= 2 * x.size for x in got)
    again = mix_sources(df.repartition(7), block_words=16, shard_words=shard).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def seats(weights, n):
    """Sainte-Lague, one seat after another; ties to the first."""
    won = [0] * len(weights)
    for _ in range(n if sum(weights) else 0):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def test_takes_block_by_block(spark):
    """Every document's words by walking over each shard's blocks one at a time."""
    from sigmill.llm.mixing import _mixed

    r = random.Random(9)
    rows = [(i, "w " * r.choice([0, 1, 3, 9, 40, 200, 900]), r.choice(["a", "a", "a", "b", "c", None])) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    block, shard_words = 8, 2000
    got = _mixed(df, block_words=block, shard_words=shard_words).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    target = level_targets(size)
    quota = dict(zip(names, seats([target[s] for s in names], int(sum(target.values()) / block + 0.5))))
    want = {}
    for s in names:
        shards = {}
        for x in got:
            if x.source == s:
                shards.setdefault(x.shard, []).append(x)
        assert set(shards) <= set(range(max(1, -(-size[s] // shard_words))))
        order = sorted(shards)
        words = [sum(x.size for x in shards[k]) for k in order]
        for k, n, q in zip(order, words, seats(words, quota[s])):
            blocks = -(-n // block)
            q = min(q, 2 * blocks)
            start = spark.sql(f"SELECT pmod(xxhash64(17, {'cast(null as string)' if s is None else repr(s)}, {k}L), {max(1, blocks)}L) AS x").first().x
            taken = [q // blocks + ((b + 1 + start) * (q % blocks) // blocks - (b + start) * (q % blocks) // blocks) for b in range(blocks)]
            assert sum(taken) == q
            at = 0
            for x in sorted(shards[k], key=lambda x: (x.h, x.doc_id, x.size)):
                want[x.doc_id] = sum(taken[w // block] for w in range(at, at + x.size))
                at += x.size
    assert {x.doc_id: x.taken for x in got} == want and len({x.shard for x in got if x.source == "a"}) > 3


def test_highest_quotients(spark):
    r = random.Random(3)
    for _ in range(4):
        w = [r.choice([0, 1, 5, 17, 100, 333.5]) for _ in range(12)]
        seats = r.randint(0, 60)
        df = spark.createDataFrame([(i, float(x), seats) for i, x in enumerate(w)], "k long, w double, seats long")
        won = [0] * len(w)
        for _ in range(seats if any(w) else 0):
            best = max(range(len(w)), key=lambda i: (w[i] / (2 * won[i] + 1), -i))
            won[best] += 1
        assert [x.quota for x in apportion(df, [], ["k"], "w", "seats").orderBy("k").collect()] == won


def test_draw_and_empty(spark):
    _, df = documents(spark, 2, 300)
    out = draw(df)
    assert out.columns == df.columns and 0 < out.count() < 2 * df.count()
    none = df.where("doc_id = -1")
    assert mix_sources(none).count() == 0 and draw(none).count() == 0


def test_draw_meets_targets(spark):
    r = random.Random(5)
    share = {"a": 350, "b": 150, "c": 250, "d": 80, None: 150}
    rows = [(10000 * k + i, " ".join(f"w{r.randint(0, 999)}" for _ in range(r.randint(100, 500))), s, i) for k, (s, n) in enumerate(share.items()) for i in range(n)]
    rows += [(99, "x y z " * 60, "c", 7)] * 100 + [(99, "x y z " * 60, "c", 8)]
    size, drawn, times = {}, {}, {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len(t.split())
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    got = draw(df).collect()
    for x in got:
        drawn[x.source] = drawn.get(x.source, 0) + len(x.text.split())
        times[x] = times.get(x, 0) + 1
    want = level_targets(size)
    assert min(want[s] / size[s] for s in size) < 0.5 and any(1.5 < want[s] / size[s] < 1.9 for s in size)
    for s in size:
        assert abs(drawn[s] - want[s]) <= 1100 + 0.005 * want[s], (s, drawn[s], want[s], size[s])
    assert max(n for x, n in times.items() if x.doc_id != 99) <= 2
    assert sorted(map(str, draw(df.repartition(7)).collect())) == sorted(map(str, got))
