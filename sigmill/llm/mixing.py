"""Mixing sources to target weights by Sainte-Lague apportionment.

Built of DataFrame operations only. Two levels of apportionment use the same
highest-quotient rule (quotients weight / (2 * seats + 1)): blocks to sources
by their targets, then each source's blocks to its shards by their words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents, materialize, struct_of


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def apportion(parties: DataFrame, group: list[str], keys: list[str], weight: str, seats: str) -> DataFrame:
    """Exact highest-quotient apportionment of ``seats`` (equal within a group).

    Every party first gets round(weight / divisor) seats for a divisor so
    large that no group exceeds its seats; what is left (at most one seat a
    party) goes to the highest of the next quotients. Ties go to the smaller
    key. Groups without weight get nothing. Adds ``quota`` (long).
    """
    by = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    rest = [c for c in parties.columns]
    p = (
        parties.withColumn("_w", F.col(weight).cast("double"))
        .withColumn("_sum", F.sum("_w").over(by))
        .withColumn("_n", F.count(F.lit(1)).over(by))
        .withColumn("_share", F.try_divide("_w", "_sum"))
        .withColumn("_sure", F.coalesce(F.greatest(F.lit(0), F.floor(F.col("_share") * (F.col(seats) - F.col("_n") / 2) + 0.5)), F.lit(0)).cast("long"))
        .withColumn("_left", F.col(seats) - F.sum("_sure").over(by))
    )
    more = F.when(F.col("_w") > 0, F.sequence(F.col("_sure"), F.col("_sure") + F.ceil(F.col("_share") * F.col("_n")) + 1))
    ranked = p.withColumn("_seat", F.explode_outer(more)).withColumn("_q", F.col("_w") / (2 * F.col("_seat") + 1))
    order = by.orderBy(F.col("_q").desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys], F.col("_seat"))
    won = ranked.withColumn("_won", ((F.row_number().over(order) <= F.col("_left")) & F.col("_q").isNotNull()).cast("long"))
    return won.groupBy(*rest).agg((F.max("_sure") + F.sum("_won")).alias("quota"))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row per source: size, number of documents, weight and target words.

    Sources in code point order (null last) take ``weights`` in turn. Targets
    add up to ``share`` of all words, in proportion to the weights, but none
    is above ``most`` times its source's size: what is cut off is shared again
    by weight. The level at which that ends is found from running sums over
    the sources ordered by cap / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    everything = Window.partitionBy(F.lit(0))
    turn = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    s = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("_ratio", F.col("cap") / F.col("weight")).withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
    order = everything.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("_open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_open"))
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything)
    return s.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))).select("source", "source_size", "docs", "weight", "target")


def _mixed(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 32,
    shard_words: int = 1 << 17,
    most_shards: int = 1 << 16,
    seed: int = 17,
) -> DataFrame:
    """What ``mix_sources`` returns, with h (the seeded hash) and the shard of every row."""
    sizes = materialize(docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("h")), "mix-sizes")
    source = materialize(targets(sizes, weights, share, most), "mix-sources")
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    per_shard = F.greatest(F.lit(shard_words), F.ceil(total / most_shards))
    seats = F.floor(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words + 0.5).cast("long")
    source = source.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / per_shard)).cast("long")).withColumn("seats", seats)
    quotas = apportion(source, [], ["source"], "target", "seats")

    def same(a: DataFrame, b: DataFrame, column: str = "source"):
        return a[column].eqNullSafe(b[column])

    dealt = sizes.join(quotas, same(sizes, quotas), "left").select("doc_id", sizes["source"], "size", "h", "source_size", "target", "quota", F.pmod(F.xxhash64("h"), "shards").alias("shard"))
    line = Window.partitionBy("source", "shard")
    placed = dealt.withColumn("end", F.sum("size").over(line.orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    placed = materialize(placed.withColumn("start", F.col("end") - F.col("size")), "mix-placed")

    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.max("quota").alias("source_quota"))
    shards = shards.withColumn("blocks", F.ceil(F.col("words") / block_words))
    shards = apportion(shards, ["source"], ["shard"], "words", "source_quota")
    shards = shards.withColumn("quota", F.least(F.col("quota"), (F.col("blocks") * most).cast("long")))
    start = F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.greatest(F.lit(1), F.col("blocks")))
    shards = shards.select("source", F.col("shard").alias("_shard"), "blocks", "quota", start.alias("first"))
    out = placed.drop("quota").join(shards, placed["source"].eqNullSafe(shards["source"]) & (F.col("shard") == F.col("_shard")), "left").drop(shards["source"])

    #: Blocks before block b that are taken once more, by a running share of
    #: the remainder; differences of this give any range without a loop.
    extra = F.expr("quota % blocks")
    upto = lambda b: F.floor(((b + F.col("first")) * extra) / F.col("blocks"))
    takes = lambda lo, hi: F.floor(F.col("quota") / F.col("blocks")) * (hi - lo) + upto(hi) - upto(lo)
    b = F.lit(block_words)
    lo, hi = F.floor(F.col("start") / b), F.floor((F.col("end") - 1) / b)
    one = lambda k: takes(k, k + 1)
    inside = F.when(lo == hi, F.col("size") * one(lo)).otherwise(((lo + 1) * b - F.col("start")) * one(lo) + b * takes(lo + 1, hi) + (F.col("end") - hi * b) * one(hi))
    taken = F.when((F.col("size") > 0) & (F.col("blocks") > 0), inside).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"), "h", "shard")


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """How many words of every document a weighted mix of the sources takes.

    ``how`` goes to ``_mixed``; ``docs`` needs doc_id, text and source. A
    source's documents are dealt by a seeded hash to shards of about ``shard_words`` words, so a hot source is
    many shards, and lie there end to end in seeded order; each shard is cut
    into blocks of ``block_words`` words. Blocks are allotted to sources and
    on to shards as integer quotas; a quota of q over b blocks takes every
    block q // b times and q % b of them once more, spread evenly from a
    seeded start. A document takes what the blocks over it take.

    Nulls: a null text has size 0 and takes 0; a null source is a source of
    its own, last in order; a null doc_id is hashed like any other. Repeated
    rows are separate rows. Empty input gives no rows. Other columns of
    ``docs`` are not looked at.

    Returns doc_id, source, size, source_size, target, taken.
    """
    return _mixed(docs, **how).drop("h", "shard")


def draw(docs: DataFrame, **how) -> DataFrame:
    """Rows of ``docs``, all columns, each as often as the mix takes it.

    A row's share (words taken over its size) is rounded up or down to whole
    copies with a carry: along a shard, ordered by size, copies are where the
    running sum of shares from a seeded start passes a whole number. A row is
    drawn its share of times on average, and a shard's words are off by at
    most two of its longest rows. Rows without words (null and empty texts
    too) have nothing to take and go; a null source is a source of its own; a
    null doc_id is like any other. Rows equal in all columns (none may be a
    map) count together. Columns may have any names. Empty input gives no
    rows.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.select(F.xxhash64(*[x for c in columns for x in (c, c.isNull())]).alias("_key"), "text", "source", struct_of(docs.columns).alias("_row"))
    mixed = _mixed(own.select(F.col("_key").alias("doc_id"), "text", "source"), **how)
    one = 1 << 32  # a whole copy; shares are whole numbers, so sums are exact in any order
    share = F.floor(F.sum("taken") / F.sum("size") * F.count(F.lit(1)) * one + 0.5).cast("long")
    rows = mixed.where("size > 0").groupBy(F.col("doc_id").alias("_key"), "source", "shard", "h", "size").agg(F.count(F.lit(1)).alias("_rows"), share.alias("_share"))
    line = Window.partitionBy("source", "shard").orderBy("size", "h", "_key").rowsBetween(Window.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64(F.lit("draw"), "source", "shard"), F.lit(one))
    upto = rows.withColumn("_to", F.sum("_share").over(line) + start)
    times = upto.select("_key", "_rows", (F.shiftright("_to", 32) - F.shiftright(F.col("_to") - F.col("_share"), 32)).cast("int").alias("_times"))
    times = materialize(times.where("_times > 0"), "mix-times")
    drawn = own.select("_key", "_row").join(times, "_key")
    drawn = drawn.where("_rows = 1").unionByName(drawn.where("_rows > 1").dropDuplicates(["_key"]))
    return drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select("_row.*")


def op1_mixing(spark, sf_dir):
    return mix_sources(documents(spark, sf_dir), block_words=16).drop("source")
