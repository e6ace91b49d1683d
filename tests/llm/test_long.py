"""Very long texts (several MB, past the segment of 2^20) next to null, empty and short ones, in every operator on texts."""

import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sigmill.llm import mixing, packing, quality_rules, ranking, records, simhash, toxicity
from sigmill.llm.substring_dedup import remove_passages
from sigmill.llm.suffix_dedup import remove_repeats

from . import brute

WORDS = 450_000


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    pool = ["".join(r.choice("abcdeü") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    long = [r.choice(pool) for _ in range(WORDS)]
    passage = [f"p{i}" for i in range(70)]
    other = [r.choice(pool) for _ in range(300)]
    # one copy of the passage lies across 2^20 bytes, one near the end
    size, at = 0, 0
    while size < (1 << 20) - 150:
        size += len(long[at].encode()) + 1
        at += 1
    long[at:at] = passage
    long[-100:-100] = passage
    texts = [" ".join(long), " ".join([*other[:150], *passage, *other[150:]]), None, "", "short one"]
    assert len(texts[0].encode()) > 2 << 20
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(k, t, "a") for k, t in rows], "doc_id long, text string, source string")


def test_windows(docs, rows):
    got = {x.doc_id: x for x in remove_repeats(docs).collect()}
    assert {k: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for k, x in got.items()} == {k: b for (k, _), b in zip(rows, brute.suffix_dedup(rows, 200))}
    assert got[0].n_spans == 2 and got[1].n_spans == 1
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in remove_passages(docs).collect()}
    assert got == {k: b for (k, _), b in zip(rows, brute.substring_dedup(rows, 50))} and got[1][1] == 70


def test_fingerprints(docs, rows):
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(docs).collect()}
    assert got == {k: x for (k, _), x in zip(rows, brute.near_duplicates(rows))}


def test_tokens(spark, docs, rows, tmp_path):
    file = public_tokenizers.path("word_bpe_49k.json")
    records.write_records(docs, str(tmp_path / "r"), file, spaces=False, end_id=1, files=2)
    records.build_index(spark, str(tmp_path / "r"), str(tmp_path / "i"))
    import numpy as np

    model = Tokenizer.from_file(file)
    ids = [[*model.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows]
    got = {x.doc_id: (x.n_tokens, x.ids_crc32) for x in records.record_digests(spark, str(tmp_path / "i")).collect()}
    assert got == {k: (len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (k, _), i in zip(rows, ids)}
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    per = {x.doc_id: (x.n, x.total) for x in packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")).collect()}
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, t in rows:
        n = len(model.encode(t or "", add_special_tokens=False).ids) + 1
        assert per[k] == (-(-n // 1024), n)


def test_models_and_counts(spark, docs, rows):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, toxicity.chain_labels(labels)).count() == ranking.rank_quality(docs, labels).count() == 5
    got = {x.doc_id: x for x in quality_rules.judge(docs, labels).collect()}
    for k, t in rows:
        w = [x.decode() for x in brute.words(t)]
        assert (got[k].n_words, got[k].n_repeat_words) == (len(w), brute.repeat_words(w))
    mixed = {x.doc_id: x for x in mixing.mix_sources(docs).collect()}
    assert all(mixed[k].size == len(brute.words(t)) and 0 <= mixed[k].taken <= 2 * mixed[k].size for k, t in rows)
    drawn = {x.doc_id: x["count"] for x in mixing.draw(docs).groupBy("doc_id").count().collect()}
    assert 0 < drawn[0] <= 2 and not {2, 3} & set(drawn)
