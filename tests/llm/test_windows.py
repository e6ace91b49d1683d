import random

import pytest

from sigmill.llm.substring_dedup import Automaton, remove_passages
from sigmill.llm.suffix_dedup import remove_repeats, suffix_array

from . import brute


def texts(seed, n=60):
    """Documents with copies, edits, shared passages, runs, nulls and long ones."""
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdeüñ") for _ in range(r.randint(1, 6))) for _ in range(60)]
    some = lambda k: " ".join(r.choice(pool) for _ in range(k))
    passages = [some(r.randint(20, 90)) for _ in range(4)]
    out = []
    for _ in range(n):
        t = some(r.randint(0, 120))
        for p in r.sample(passages, r.randint(0, 2)):
            cut = r.randint(0, len(p) // 3)
            t = t[: len(t) // 2] + p[cut:] + t[len(t) // 2 :]
        out.append(t)
    for t in r.sample(out, 8):
        w = t.split(" ")
        w[r.randrange(len(w))] = "changed"
        out += [t, " ".join(w)]
    out += [None, "", "a" * 700, "b" * 450 + "a" * 300, "ab " * 200, "ab " * 200 + "c", some(3000), passages[0] + "\n\t" + passages[0]]
    rows = list(enumerate(out))
    r.shuffle(rows)
    return rows + [(None, passages[0]), (None, None), rows[0], rows[0]]


def test_suffix_array():
    r = random.Random(1)
    for _ in range(300):
        s = [r.randrange(r.choice([1, 2, 3, 20])) for _ in range(r.randrange(0, 60))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    for s in ([0] * 50, list(range(50)), list(range(50))[::-1], [1, 0] * 30, [0, 1] * 30 + [0]):
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_automaton():
    r = random.Random(2)
    for _ in range(100):
        seqs = [[r.randrange(3) for _ in range(r.randrange(1, 25))] for _ in range(4)]
        a = Automaton()
        for s in seqs[:3]:
            a.add(s)
        subs = {tuple(s[i:j]) for s in seqs[:3] for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        want = [max([n for n in range(1, e + 2) if tuple(seqs[3][e + 1 - n : e + 1]) in subs], default=0) for e in range(len(seqs[3]))]
        assert a.statistics(seqs[3]) == want


@pytest.mark.parametrize("seed,cap", [(1, None), (2, 1), (3, None), (4, 6)])
def test_suffix_dedup(spark, seed, cap):
    rows = texts(seed)
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, n_bytes string").repartition(5)
    got = remove_repeats(df, cap=cap).collect()
    assert all(x.kept_text is not None or x.n_bytes == 0 for x in got)
    assert sorted((x.doc_id or -1, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == sorted((k or -1, *b) for (k, _), b in zip(rows, brute.suffix_dedup(rows, 200)))


@pytest.mark.parametrize("seed,cap", [(1, None), (2, 1), (3, None), (4, 6)])
def test_substring_dedup(spark, seed, cap):
    rows = texts(seed)
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, key string").repartition(5)
    got = remove_passages(df, cap=cap).collect()
    assert sorted((x.doc_id or -1, x.n_words, x.n_removed, x.kept_sha256) for x in got) == sorted((k or -1, *b) for (k, _), b in zip(rows, brute.substring_dedup(rows, 50)))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).count() == 0 and remove_passages(df).count() == 0


def test_keep(spark):
    df = spark.createDataFrame([(1, "x", "en"), (2, None, None)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, remove_passages(df, keep=("doc_id", "lang")).select("doc_id", "lang", "kept_text").collect())) == [(1, "en", "x"), (2, None, None)]
    with pytest.raises(ValueError):
        remove_passages(df.withColumn("n_words", df.doc_id), keep=("doc_id", "n_words"))


@pytest.mark.parametrize("cap", [8, 25])
def test_one_passage_in_many_surroundings(spark, cap, monkeypatch):
    """More contexts of an anchor than the cap: runs of windows go to the solvers, none to plain counts where they fit."""
    from sigmill.llm import windows

    calls = []
    plain = windows.Windows._one_by_one
    monkeypatch.setattr(windows.Windows, "_one_by_one", lambda self, contexts: calls.append(contexts.count()) or plain(self, contexts))
    r = random.Random(21)
    pool = ["".join(r.choice("abcdefgü") for _ in range(r.randint(2, 7))) for _ in range(500)]
    passage = [r.choice(pool) for _ in range(120)]
    rows = []
    for i in range(60):
        a, b = r.randint(0, 40), r.randint(80, 120)
        before, after = ([r.choice(pool) for _ in range(r.randint(3, 30))] for _ in range(2))
        rows.append((i, " ".join([*before, *passage[a:b], *after])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in remove_repeats(df, cap=cap).collect()}
    assert got == dict(zip(range(60), brute.suffix_dedup(rows, 200)))
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in remove_passages(df, cap=cap).collect()}
    assert got == dict(zip(range(60), brute.substring_dedup(rows, 50)))
    assert cap < 25 or not calls
