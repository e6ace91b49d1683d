"""Shared pieces: scratch tables, joins that survive hot keys, row identity."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys that hold at least this share of all rows are "hot"; there are at most
#: 1 / HOT_SHARE of them, which bounds the table that is broadcast for them.
HOT_SHARE = 1 / 1024
#: Bytes of a batch of rows that goes to a Python worker, about.
BATCH = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Batches that go to Python workers end at ``BATCH`` bytes in this session; a lower bound stays.

    Spark's own bound is 64 MB or 10,000 rows. A batch lies in the executor's
    memory outside its heap, in the worker as Arrow data and once more as
    Python strings, for each task that runs. What workers return is the same.
    """
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only on one machine (a local master) where that is unset, as in tests, a
    temporary folder is made, and removed when the process ends. On a cluster
    an unset folder is an error, as other executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="sigmill-")
        atexit.register(shutil.rmtree, made, True)
        base = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is there goes when the driver's JVM ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage in a way that outlives any executor, keeps columns
    prunable and gives the optimiser real sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def struct_of(columns: list[str]) -> Column:
    """The columns (of any names) as one struct."""
    return F.struct(*[F.col(f"`{c}`") for c in columns])


def whole_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and ``row``: all columns of ``docs`` as a struct, so that none clashes with others."""
    return docs.select("doc_id", "text", struct_of(docs.columns).alias("row"))


def row_key(*columns: str) -> Column:
    """Identity of an input row: equal only for rows equal in ``columns``."""
    return F.xxhash64(*[F.col(c) for c in columns])


def join_unique(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which is unique in ``keys``.

    ``weight`` says how many of the ``total`` rows have the key. Rows of hot
    keys meet a broadcast table of at most 1 / HOT_SHARE keys, so they stay
    where they are; the other rows are joined by a shuffle.
    """
    least = max(2, int(total * HOT_SHARE))
    hot, cold = table.where(F.col(weight) >= least), table.where(F.col(weight) < least)
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return near.unionByName(far)


def split_by_keys(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` (long) may be among ``keys``, and those whose key surely isn't.

    A bitmap of hashed keys tells them apart: at most 2^27 bits (16 MB), so it
    can be broadcast whatever the number of keys. Rows of the second kind need
    no join with a table of these keys, and so no shuffle.
    """
    bits = min(27, max(15, int(64 * keys.count()).bit_length()))
    place = lambda: F.pmod(F.xxhash64(key), F.lit(1 << bits)) + 1
    maps = keys.select(place().alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_map"))
    marked = rows.select(struct_of(rows.columns).alias("_all"), F.bitmap_bucket_number(place()).alias("_bucket"), F.bitmap_bit_position(place()).alias("_bit"))
    marked = marked.join(F.broadcast(maps), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_map", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.floor(byte / F.pow(F.lit(2), F.pmod("_bit", F.lit(8)))).cast("int") % 2 == 1, F.lit(False))
    return marked.where(found).select("_all.*"), marked.where(~found).select("_all.*")


def marked_members(rows: DataFrame, keys: DataFrame, key: str, result: str, few: int = 1 << 16, bits: int = 27) -> DataFrame:
    """``rows`` and a boolean ``result``: whether ``key`` is among ``keys`` (distinct, not null), without moving rows.

    A bitmap of hashed keys (at most 2^``bits`` bits) is right but for the keys
    of ``rows`` that it takes in wrongly. These are found by a join of keys
    alone, and a second bitmap tells them apart but for some of ``keys``, and
    so on; each set is found in the one before it but one. At most ``few`` keys
    left are broadcast as they are. Where bitmaps are too full for sets to
    shrink, the last set is joined as Spark chooses. Exact either way; a null
    key is in no set.
    """
    here = rows.schema[key].dataType
    inside = materialize(keys.select(F.col(key).cast(here).alias("_k")), "members-keys")
    outside, sets, n = None, [inside], inside.count()
    maps: list[DataFrame] = []

    def place(column: str, level: int, size: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(level), column), F.lit(1 << size)) + 1

    def hit(df: DataFrame, column: str, level: int, size: int) -> DataFrame:
        """``df`` with _hit: whether the bitmap of a level takes ``column`` in."""
        at = place(column, level, size)
        df = df.withColumns({"_bucket": F.bitmap_bucket_number(at), "_bit": F.bitmap_bit_position(at)}).join(F.broadcast(maps[level]), "_bucket", "left")
        byte = F.conv(F.hex(F.substring("_map", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = F.coalesce(F.floor(byte / F.pow(F.lit(2), F.pmod("_bit", F.lit(8)))).cast("int") % 2 == 1, F.lit(False))
        return df.withColumn("_hit", found).drop("_bucket", "_bit", "_map")

    sizes: list[int] = []
    while n > few and len(sizes) < 8:
        level, last = len(sizes), sets[-1]
        sizes.append(min(bits, max(15, int(64 * n).bit_length())))
        at = place("_k", level, sizes[-1])
        maps.append(materialize(last.select(at.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_map")), "members-map"))
        if level == 0:
            outside = rows.select(F.col(f"`{key}`").alias("_k")).where("_k is not null")
            wrong = hit(outside, "_k", 0, sizes[0]).where("_hit").select("_k").distinct().join(inside, "_k", "left_anti")
        else:
            wrong = hit(sets[-2], "_k", level, sizes[-1]).where("_hit").select("_k")
        sets.append(materialize(wrong, "members-wrong"))
        n = sets[-1].count()
    out = rows.withColumn("_k", F.col(f"`{key}`"))
    for level, size in enumerate(sizes):
        out = hit(out, "_k", level, size).withColumnRenamed("_hit", f"_hit{level}")
    rest = sets[-1].withColumn("_last", F.lit(True))
    out = out.join(F.broadcast(rest) if n <= few else rest, "_k", "left")
    answer = F.col("_last").isNotNull()
    for level in reversed(range(len(sizes))):  # in a set: its bitmap takes it in, and it is not in the set of wrong ones
        answer = F.col(f"_hit{level}") & ~answer
    return out.withColumn(result, answer).select(*[F.col(f"`{c}`") for c in rows.columns], result)


def quantiles(df: DataFrame, column: str, shares: list[float], most: int = 1 << 14, bins: int = 1 << 12) -> list[float] | None:
    """Exact quantiles (linear between neighbours) of a double column, nulls aside; None without values.

    Ranges around a rank are counted in ever finer bins until at most ``most``
    values, or equal ones, are left; only these come to the driver.
    """
    df = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    ends = lambda: (F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    whole = df.agg(*ends()).first()
    if not whole["n"]:
        return None

    def near(rank: int) -> tuple[float, float]:
        """The values at ``rank`` (from 0) and the next rank; the same if there is none."""
        r, before, after = whole, 0, None
        while r["n"] > most and r["low"] < r["high"] and (width := (r["high"] - r["low"]) / bins) > 0:
            at = F.least(F.floor((F.col("x") - r["low"]) / width), F.lit(bins - 1))
            for x in sorted(df.where(F.col("x").between(r["low"], r["high"])).groupBy(at.alias("at")).agg(*ends()).collect(), key=lambda x: x["low"]):
                if before + x["n"] > rank:
                    break
                before += x["n"]
            r = x
        if r["low"] == r["high"]:
            values = [r["low"]] * r["n"]
        else:
            values = sorted(x["x"] for x in df.where(F.col("x").between(r["low"], r["high"])).collect())
        if rank + 1 - before < len(values):
            after = values[rank + 1 - before]
        elif rank + 1 < whole["n"]:
            after = df.where(F.col("x") > r["high"]).agg(F.min("x")).first()[0]
        return values[rank - before], values[rank - before] if after is None else after

    out = []
    for share in shares:
        at = min(1.0, max(0.0, share)) * (whole["n"] - 1)
        a, b = near(int(at))
        out.append((1 - (at - int(at))) * a + (at - int(at)) * b)
    return out


def shuffle_count(spark: SparkSession, least: int = 12) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
