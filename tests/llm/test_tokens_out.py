import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sigmill.llm import packing, records


def rows(seed=1, n=80):
    r = random.Random(seed)
    out = [(r.randrange(-50, 10_000) * 3 + i % 3, " ".join(r.choice(["the", "Cat", "sät", "on,", "漢字", "x" * 30]) for _ in range(r.choice([0, 1, 5, 50, 900])))) for i in range(n)]
    return [*out, (None, "null id"), (4, None), (5, ""), out[0], out[0]]


def test_records_round_trip(spark, tmp_path):
    data = rows()
    path, index = str(tmp_path / "r"), str(tmp_path / "i")
    file = public_tokenizers.path("word_bpe_49k.json")
    records.write_records(spark.createDataFrame([(*x, 1) for x in data], "doc_id long, text string, start long"), path, file, spaces=False, end_id=1, files=5)
    records.build_index(spark, path, index)
    model = Tokenizer.from_file(file)
    ids = {(k, t): [*model.encode(t or "", add_special_tokens=False).ids, 1] for k, t in data}
    order = sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want, at = [], 0
    for k, t in order:
        got = ids[k, t]
        want.append((k, at, len(got), zlib.crc32(np.array(got, "<u4").tobytes())))
        at += len(got)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(map(tuple, records.record_digests(spark, index).collect()), key=key) == want
    some = spark.createDataFrame([(order[5][0],), (order[40][0],)], "doc_id long")
    picked = records.read_records(spark, path, index, some).collect()
    assert sorted((x.doc_id, x.ids) for x in picked) == sorted((k, ids[k, t]) for k, t in data if k in (order[5][0], order[40][0]))


def test_damage_is_noticed():
    good = records.frame(7, np.arange(5), 2) + b"\n" + records.frame(None, np.arange(3), 4) + b"\n"
    assert [(k, i.tolist()) for _, k, i in records.frames(good)] == [(7, [0, 1, 2, 3, 4]), (None, [0, 1, 2])]
    for at in range(len(good)):
        if at in (len(records.frame(7, np.arange(5), 2)), len(good) - 1):
            continue  # newlines carry nothing
        bad = good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]
        with pytest.raises(ValueError):
            list(records.frames(bad))


def test_packing(spark):
    data = rows(2, 150)
    file = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(*x, 1) for x in data], "doc_id long, text string, length long")
    got = packing.pack_documents(df, file, capacity=128, group=60, with_ids=True).collect()
    model = Tokenizer.from_file(file)
    docs = defaultdict(list)
    for k, t in data:
        docs[k].append([*model.encode(t or "", add_special_tokens=False).ids, 2])
    pieces = defaultdict(list)
    for x in got:
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) and len(x.ids) == x.length <= 128
        pieces[x.doc_id].append(x)
    for k, some in docs.items():
        want = []
        for ids in some:
            first = len(ids) % 128 if len(ids) > 128 else len(ids)
            cuts = ([0, first] if first else [0]) + list(range(first + 128, len(ids) + 1, 128))
            want += [(n, a, tuple(ids[a:b])) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((x.piece, x.start, tuple(x.ids)) for x in pieces[k]) == sorted(want)
    bins = defaultdict(list)
    for x in got:
        bins[x.sequence_id].append((x.offset, x.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 128
    least = -(-sum(x.length for x in got) // 128)
    assert len(bins) <= least + 4
    assert packing.pack_documents(df.where("doc_id = -9"), file).count() == 0


def test_local_search_empties_bins():
    r = random.Random(5)
    for _ in range(60):
        sizes = [r.randint(1, 60) for _ in range(r.randint(1, 60))]
        first = packing.best_fit(sizes, 100)
        bins = packing.local_search(first, sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 100 for b in bins) and len(bins) <= len(first)
    sizes = [6, 4, 5, 5, 3, 3, 2, 2]
    assert len(packing.local_search([[0], [1, 2], [3], [4, 5], [6, 7]], sizes, 10)) == 3
