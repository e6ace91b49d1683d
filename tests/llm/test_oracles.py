import os

import duckdb
import pytest

from sigmill.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(x) for x in df.select(*cols).collect()))) == sorted(map(str, want))


def test_every_operator_has_a_query():
    assert sorted({int(n[2:].split("_")[0]) for n in registry.queries()}) == list(range(1, 11))


def test_empty_tables(spark):
    from sigmill.llm import ranking, records

    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert ranking.rank_quality(docs, labels).count() == 0
    import public_tokenizers

    from sigmill.llm.common import scratch_path

    path, index = scratch_path(spark, "r"), scratch_path(spark, "i")
    records.write_records(docs, path, public_tokenizers.path("word_bpe_49k.json"), spaces=False, end_id=1)
    records.build_index(spark, path, index)
    assert records.record_digests(spark, index).count() == 0
