import random

import pytest
from pyspark.sql import functions as F

from sigmill.llm import common


@pytest.mark.parametrize("n", [0, 1, 700])
def test_split_by_keys(spark, n):
    r = random.Random(n)
    rows = spark.createDataFrame([(r.getrandbits(64) - (1 << 63), "x") for _ in range(2000)] + [(None, "n")], "key long, _map string")
    rows = common.materialize(rows, "test")
    keys = rows.where("key is not null").orderBy("key").limit(n).select("key")
    maybe, never = common.split_by_keys(rows, keys, "key")
    assert maybe.count() + never.count() == 2001 and maybe.columns == rows.columns == never.columns
    assert maybe.join(keys, "key").count() == n and never.join(keys, "key").count() == 0
    assert maybe.count() <= n + 80


def test_scratch_folder(spark):
    a, b = common.scratch_path(spark, "x"), common.scratch_path(spark, "x")
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir"))
    df = common.materialize(spark.range(5).select(F.col("id").alias("k")), "x")
    assert df.count() == 5 and "parquet" in df._jdf.queryExecution().optimizedPlan().toString()
    common.discard(df)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FAILED_READ_FILE"):
        spark.read.parquet(df._scratch).count()


@pytest.mark.parametrize("few,bits", [(1 << 16, 27), (0, 27), (20, 12), (0, 4)])
def test_marked_members(spark, few, bits):
    """Exact with one broadcast, with many levels, and where bitmaps are too full to tell anything."""
    rows = spark.range(4000).select((F.col("id") % 3000).alias("key"), F.lit("x").alias("a.b")).unionByName(spark.createDataFrame([(None, "x")], "key long, `a.b` string"))
    keys = spark.range(0, 6000, 3).select(F.col("id").alias("key"))
    got = common.marked_members(rows, keys, "key", "_in", few=few, bits=bits)
    assert got.columns == ["key", "a.b", "_in"]
    got = got.collect()
    assert len(got) == 4001 and all(x["_in"] is (x.key is not None and x.key % 3 == 0) for x in got)
    assert not any(x["_in"] for x in common.marked_members(rows, keys.limit(0), "key", "_in", few=few, bits=bits).collect())
