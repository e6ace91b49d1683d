import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sigmill.llm.common import BATCH, materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.documents(spark, SF)
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-stage")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "suffix-array dedup":
            assert docs.where("n_chars <> char_length(text)").count() == 0
    assert counts[1] <= counts[0] and counts[2] <= counts[1] and counts[3] == counts[2] and counts[5] > 0
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_empty(spark):
    none = corpus_pipeline.documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_columns_of_any_name(spark):
    """Names that the stages use themselves, nulls in all columns, repeated rows."""
    from pyspark.sql import functions as F

    docs = corpus_pipeline.documents(spark, SF).limit(60)
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]))
    for c in ("toxic_flag", "p_toxic", "row", "_key", "_row", "_times", "_copy", "n_bytes", "n_removed", "kept_text", "size", "fp", "a.b", "h", "shard", "key", "spans"):
        docs = docs.withColumn(c, F.lit(None).cast("long") if c == "h" else F.col("doc_id") * 2)
    docs = materialize(docs, "test-odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = materialize(stage(spark, docs, SF), "test-odd")
        assert docs.columns == columns
        assert docs.where("`a.b` is distinct from doc_id * 2 or _key is distinct from doc_id * 2 or `row` is distinct from doc_id * 2").count() == 0
    assert docs.count() > 0 and corpus_pipeline.pack(spark, docs, SF).count() > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES if n != "mixing"])
def test_batches_are_bounded_in_bytes(spark, name):
    """Long texts must not fill batches of 10,000 rows or 64 MB; a lower bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    long = spark.range(0, 1500, 1, 1).select(F.expr("repeat('some words ', 2000)").alias("text"))
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches)
    try:
        for before, most in ((64 << 20, 2 * BATCH), (1 << 18, 1 << 19)):
            spark.conf.set(key, before)
            dict(corpus_pipeline.STAGES)[name](spark, corpus_pipeline.documents(spark, SF).limit(0), SF)
            got = long.mapInArrow(sizes, "n long, size long").collect()
            assert sum(x.n for x in got) == 1500 and max(x.size for x in got) <= most
    finally:
        spark.conf.unset(key)
