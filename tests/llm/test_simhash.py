import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.llm import simhash
from sigmill.llm.graph import components

from . import brute


def texts(seed=1):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 6))) for _ in range(400)]
    out = []
    for _ in range(60):
        w = [r.choice(pool) for _ in range(r.randint(1, 150))]
        out.append(" ".join(w))
        for _ in range(r.randint(0, 3)):
            v = list(w)
            v[r.randrange(len(v))] = r.choice(["EDIT", "edit", "x"])
            out.append(" \n".join(v))
    out += [None, "", "  \t", "One", "one", "É one two", "a b c d", "A b\nc d e"]
    rows = list(enumerate(out))
    r.shuffle(rows)
    return rows + [rows[0], (None, out[3]), (None, "alone here")]


def test_against_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, fp long").repartition(4)
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.fingerprint, x.component_id if x.component_id is not None else -1) for x in simhash.near_duplicates(df).collect())
    want = sorted((k if k is not None else -1, f, c if c is not None else -1) for (k, _), (f, c) in zip(rows, brute.near_duplicates(rows)))
    assert got == want


@pytest.mark.parametrize("n,threshold", [(1, 4), (1 << 19, 4), (1 << 22, 5), (1 << 30, 4), (1, 7), (1, 14), (300_000, 14), (1 << 23, 14)])
def test_every_close_pair_meets_at_a_home(n, threshold):
    r = random.Random(n)
    starts, covers, blocks = simhash.choose_cover(n, threshold)
    assert all(7 in c.sizes for c in covers) and sum(c.threshold + 1 for c in covers) > threshold
    for _ in range(60):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), threshold):
            b ^= 1 << bit
        met = False
        for at, cover in zip(starts, covers):
            x, y = (simhash._part(np.array([v], np.uint64), at, cover) for v in (a, b))
            home = int(cover.homes(x)[0])
            row, anchor, flips = cover.anchors(y)
            met |= home in anchor.tolist()
            assert len(set(anchor.tolist())) == len(anchor) and int(anchor[flips == 0][0]) == int(cover.homes(y)[0])
        assert met


@pytest.mark.parametrize("bits,codes,threshold", [(9, 1, 2), (10, 1, 1), (8, 0, 3), (14, 2, 2)])
def test_anchors_are_the_homes_in_reach(bits, codes, threshold):
    cover = simhash.Cover(bits, codes, threshold)
    r = random.Random(bits)
    values = np.arange(1 << bits, dtype=np.uint64)
    home = cover.homes(values)
    for x in r.sample(range(1 << bits), 12):
        near = np.bitwise_count(values ^ np.uint64(x)) <= threshold
        row, anchor, _ = cover.anchors(np.array([x], np.uint64))
        assert set(anchor.tolist()) == set(home[near].tolist()) and len(anchor) == len(set(anchor.tolist()))
        for blocks in range(1, len(cover.sizes)):  # by way of the cells
            mask = np.uint64((1 << sum(cover.sizes[:blocks])) - 1)
            _, cells, _ = cover.anchors(np.array([x], np.uint64), blocks)
            assert set(cells.tolist()) == set((anchor & mask).tolist())
            inside = [cover.anchors(np.array([x], np.uint64), blocks, np.array([c], np.uint64))[1].tolist() for c in cells]
            assert sorted(a for some in inside for a in some) == sorted(anchor.tolist())
    every, _, _ = cover.anchors(values)
    assert abs(len(every) / len(values) - cover.reach()) < 1e-9 and len(np.unique(home)) == cover.count()


@pytest.mark.parametrize("cell", [1 << 17, 6])
def test_links_hold_all_pairs(spark, monkeypatch, cell):
    """Against all pairs, plain and with second fingerprints and sizes, with split cells too."""
    monkeypatch.setattr(simhash, "CELL", cell)
    r = random.Random(4)
    fps = []
    for _ in range(25):
        a, b = r.getrandbits(64), r.getrandbits(64)
        fps.append((a, b, r.randint(50, 70)))
        for _ in range(5):
            flip = lambda x, k: x ^ sum(1 << i for i in r.sample(range(64), k))
            fps.append((flip(a, r.randint(1, 14)), flip(b, r.randint(0, 20)), r.randint(50, 70)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(a), signed(b), s) for a, b, s in fps], "fp long, second long, size long").repartition(3)

    def groups(edges, names):
        part = {k: k for k in names}
        for u, v in edges:
            x, y = part[u], part[v]
            part = {k: min(x, y) if p in (x, y) else p for k, p in part.items()}
        return part

    names = [signed(a) for a, _, _ in fps]
    near = [(names[i], names[j]) for i in range(len(fps)) for j in range(i) if (fps[i][0] ^ fps[j][0]).bit_count() <= 6]
    assert groups([tuple(x) for x in simhash.links(df, 6).collect()], names) == groups(near, names)
    names = simhash.node(np.array([a for a, _, _ in fps], np.uint64), np.array([b for _, b, _ in fps], np.uint64)).tolist()
    near = [
        (names[i], names[j])
        for i in range(len(fps))
        for j in range(i)
        if (d := (fps[i][0] ^ fps[j][0]).bit_count()) <= 14 and d + (fps[i][1] ^ fps[j][1]).bit_count() <= 30 and min(fps[i][2], fps[j][2]) >= 0.8 * max(fps[i][2], fps[j][2])
    ]
    got = [tuple(x) for x in simhash.links(df, 14, 30, 0.8).collect()]
    assert {tuple(sorted(x)) for x in got} <= {tuple(sorted(x)) for x in near} and groups(got, names) == groups(near, names)


def test_copies_for_a_wide_radius_stay_bounded(spark, monkeypatch):
    """With the cover of three million fingerprints, each one travels in 3000 bytes at most (973 copies of 20 before)."""
    choose, n = simhash.choose_cover, 20_000
    monkeypatch.setattr(simhash, "choose_cover", lambda _, *more: choose(3_000_000, *more))
    r = np.random.default_rng(8)
    fp, second = (r.integers(-(1 << 63), 1 << 63, n).tolist() for _ in range(2))
    fp[1], second[1] = fp[0] ^ 0b10110111, second[0] ^ 0b1001
    df = spark.createDataFrame([(a, b, 60) for a, b in zip(fp, second)], "fp long, second long, size long").repartition(3).persist()
    df.count()
    folders = [Path(str(x)) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    written = lambda: sum(x.stat().st_size for top in folders for x in top.rglob("shuffle_*.data"))
    before = written()
    got = {tuple(sorted(x)) for x in simhash.links(df, 14, 30, 0.8).collect()}
    assert written() - before <= 3000 * n
    assert tuple(sorted(simhash.node(np.array(fp[:2]).view(np.uint64), np.array(second[:2]).view(np.uint64)).tolist())) in got


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(50)]
    part = {}

    def root(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        part[b] = a
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: min(y for y in linked if root(y) == root(x)) for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(3, base), (1, base + " more"), (9, "unlike anything else at all in here"), (9, "unlike anything else at all in here"), (None, base), (5, None)]
    df = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, source string")
    assert sorted((x.doc_id, x.source) for x in simhash.keep_one(df).collect()) == [(1, "s"), (5, "s"), (9, "s")]
    assert simhash.keep_one(df.where(F.lit(False))).count() == 0 and simhash.near_duplicates(df.where(F.lit(False))).count() == 0


def test_only_similar_texts_are_dropped(spark):
    """What goes is what is similar to something that stays, or linked to it by similar texts."""
    r = random.Random(11)
    pool = [f"w{i}" for i in range(900)]
    rows = []
    for _ in range(40):
        w = [r.choice(pool) for _ in range(120)]
        rows.append(" ".join(w))
        for edits in (1, 2, 6):
            v = list(w)
            for k in range(edits):
                v[(k * 17 + 3) % 120] = f"new{r.random()}"
            rows.append(" ".join(v))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {x.doc_id for x in simhash.keep_one(df).collect()}
    sets = [simhash.shingles(t, 5) for t in rows]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    for k in set(range(len(rows))) - kept:
        assert any(alike(k, j) for j in range(len(rows)) if j != k)
    part = plain_groups(sets)
    assert kept == {min(k for k in range(len(rows)) if part[k] == p) for p in set(part)}


@pytest.mark.parametrize("words", [60, 150, 400])
def test_pairs_at_the_similarity_are_found(spark, words):
    """At least 0.9 of pairs of 0.8 to 0.85, of words changed here and there and of parts cut off."""
    r = random.Random(words)
    pairs = []
    while len(pairs) < 200:
        w = [f"w{r.randrange(4000)}" for _ in range(words)]
        v = list(w)
        if len(pairs) % 2:
            for k in r.sample(range(words), r.randint(1, words // 30)):
                v[k] = f"n{r.random()}"
        else:
            v = v[: words - r.randint(words // 8, words // 4)]
        a, b = (simhash.shingles(" ".join(x), 5) for x in (w, v))
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            pairs.append((" ".join(w), " ".join(v)))
    df = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "doc_id long, text string")
    kept = {x.doc_id for x in simhash.keep_one(df).collect()}
    assert all(2 * i in kept for i in range(len(pairs)))
    found = sum(2 * i + 1 not in kept for i in range(len(pairs)))
    print("found", words, found)
    assert found >= 180


def test_columns_of_any_name_and_long_texts(spark):
    long = " ".join(f"w{i % 70001}" for i in range(300_000))
    rows = [(1, long, 1, 2, 3), (2, long + " end", 1, 2, 3), (3, "short", None, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key long, fp long, `node.x` long")
    out = simhash.keep_one(df)
    assert out.columns == df.columns and sorted(x.doc_id for x in out.collect()) == [1, 3]
    assert len({x.component_id for x in simhash.near_duplicates(df).collect()}) == 2


def test_link_group_spans_what_is_linked():
    r = np.random.default_rng(3)
    for _ in range(30):
        n = int(r.integers(2, 60))
        centre = r.integers(0, 1 << 62, 3, dtype=np.uint64)
        fp = np.unique(centre[r.integers(0, 3, n)] ^ (np.uint64(1) << r.integers(0, 9, n).astype(np.uint64)))
        edges = simhash.link_group(fp, np.ones(len(fp), bool), 4)
        part = list(range(len(fp)))
        for a, b in edges:
            assert int(fp[a] ^ fp[b]).bit_count() <= 4
            part = [part[a] if x == part[b] else x for x in part]
        for i in range(len(fp)):
            for j in range(i):
                if int(fp[i] ^ fp[j]).bit_count() <= 4:
                    assert part[i] == part[j]
        assert len(edges) == len(fp) - len(set(part))


def plain_groups(sets, similarity=0.8):
    part = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if part[i] != part[j] and min(len(a), len(sets[j])) >= similarity * max(len(a), len(sets[j])) and len(a & sets[j]) >= similarity * len(a | sets[j]):
                part = [part[i] if x == part[j] else x for x in part]
    return part


def test_one_of_each_group_of_many_near_copies_stays(spark):
    r = random.Random(1)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    rows = [" ".join(base)]
    for _ in range(300):
        v = list(base)
        for k in r.sample(range(200), 4):
            v[k] = f"new{r.random()}"
        rows.append(" ".join(v))
    part = plain_groups([simhash.shingles(t, 5) for t in rows])
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    kept = [x.doc_id for x in simhash.keep_one(df).collect()]
    assert sorted(kept) == sorted({part.index(p) for p in part})


def test_similar_pairs_join_the_same_by_blocks():
    r = random.Random(8)
    base = [set(range(k * 100, k * 100 + 60)) for k in range(4)]
    sets = [set(r.sample(sorted(r.choice(base)), r.randint(50, 60))) for _ in range(80)]
    flat, sizes = np.array([x for s in sets for x in sorted(s)]), np.array([len(s) for s in sets])
    block = np.array([r.randrange(2) for _ in sets])
    edges = simhash.similar_pairs(flat, sizes, block, 0.8)
    for k in (0, 1):
        own = np.flatnonzero(block == k)
        inner = simhash.similar_pairs(np.concatenate([sorted(sets[i]) for i in own]), sizes[own], None, 0.8)
        edges += [(int(own[i]), int(own[j])) for i, j in inner]
    part, want = list(range(len(sets))), plain_groups(sets)
    for a, b in edges:
        assert len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
        part = [part[a] if x == part[b] else x for x in part]
    assert all((part[i] == part[j]) == (want[i] == want[j]) for i in range(80) for j in range(i))
