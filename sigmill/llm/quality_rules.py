"""Quality rules: base counts of a text, and an n-gram likelihood ratio.

DataFrame operations only. N-grams are single words and pairs of neighbouring
words, whole and unchanged, hashed into a fixed number of buckets. The trusted
target and the raw corpus are multinomials over the buckets, and a text's score
is the mean over its n-grams of ln(target / raw).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, documents, marked_members, materialize, quantiles

SYMBOLS = r"[#*$%&|<>]"
#: Up to so many repeated windows are looked up one by one; for more, windows
#: are sorted. Both give the same count.
FEW = 32


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _covered(starts: Column, size: int) -> Column:
    """How many places the windows of ``size`` at ascending ``starts`` cover."""
    gaps = F.zip_with(F.slice(starts, 2, F.size(starts)), F.slice(starts, 1, F.size(starts) - 1), lambda b, a: F.least(F.lit(size), b - a))
    return F.when(F.size(starts) > 0, F.aggregate(gaps, F.lit(size), lambda s, x: s + x)).otherwise(F.lit(0))


def with_repeats(df: DataFrame, words_: str, size: int, name: str) -> DataFrame:
    """Add the number of words in windows of ``size`` words found twice or more in the row.

    Works within the row, on arrays of window hashes: no shuffle, and a text
    without repeats costs one pass.
    """
    w = F.col(words_)
    hashes = F.transform(F.slice(w, 1, F.greatest(F.lit(0), F.size(w) - size + 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]))
    df = df.withColumn("_h", hashes)
    h = F.col("_h")
    df = df.withColumn("_s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)))
    s = F.col("_s")
    twice = F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1)))
    df = df.withColumn("_t", F.when(s.isNotNull(), twice))
    t = F.col("_t")
    few = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(t, x), i)), lambda i: i.isNotNull())
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn("_p", F.when(F.size(t) > FEW, pairs))
    p = F.col("_p")
    same = lambda a, b: a["x"] == b["x"]
    many = F.sort_array(F.transform(F.filter(p, lambda a, i: F.coalesce(same(a, F.get(p, i + 1)), F.lit(False)) | F.coalesce((i > 0) & same(a, F.get(p, F.greatest(i - 1, F.lit(0)))), F.lit(False))), lambda a: a["i"]))
    df = df.withColumn("_at", F.when(t.isNull(), F.array().cast("array<int>")).when(p.isNull(), few).otherwise(many))
    return df.withColumn(name, _covered(F.col("_at"), size).cast("long")).drop("_h", "_s", "_t", "_p", "_at")


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with _w (words) and the counts of the base rules."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    df = docs.withColumn("_w", words()).withColumn("_lines", lines)
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    ).drop("_lines")
    return with_repeats(df, "_w", 3, "n_repeat_words")


def grams(df: DataFrame, keep: list[str], buckets: int) -> DataFrame:
    """One row for each word of _w: ``keep`` and the buckets b1 (the word) and b2 (it and the next; null at the end)."""
    n = F.size("_w")
    pairs = F.arrays_zip(F.col("_w").alias("x"), F.slice("_w", F.lit(2), F.greatest(n, F.lit(1))).alias("y"))
    each = df.select(*keep, F.inline_outer(pairs).alias("x", "y"))
    b = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    return each.select(*keep, F.when(F.col("x").isNotNull(), b("x")).alias("b1"), F.when(F.col("y").isNotNull(), b("x", "y")).alias("b2"))


def log_ratios(docs: DataFrame, buckets: int, smooth: float) -> DataFrame:
    """ln(target / raw) of every bucket as one array, in one row.

    Raw counts are over all of ``docs``, those of the target over rows where its column target is true.
    """
    each = grams(docs.select(F.col("target").cast("long").alias("_t"), words().alias("_w")), ["_t"], buckets).select("_t", F.explode(F.array("b1", "b2")).alias("b")).where("b is not null")
    counts = each.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("_t").alias("t"))
    full = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").fillna(0)
    totals = full.agg(F.sum("n").alias("_n"), F.sum("t").alias("_t"), F.collect_list(F.struct("b", "n", "t")).alias("_all"))
    share = lambda x, total: (x + F.lit(smooth)) / (F.col(total) + F.lit(smooth * buckets))
    ratio = F.transform(F.sort_array("_all"), lambda r: F.ln(share(r["t"], "_t") / share(r["n"], "_n")))
    return totals.select(F.when(F.col("_t") > 0, ratio).otherwise(F.transform("_all", lambda r: F.lit(0.0))).alias("ratios"))


def scored(df: DataFrame, keep: list[str], ratios: Column, buckets: int) -> DataFrame:
    """``keep`` and the score (mean ratio of the n-grams, null without words) of every row; df has _w and a _row of its own."""
    of = lambda c: F.coalesce(F.get(ratios, F.col(c)), F.lit(0.0))
    each = grams(df, ["_row", *keep], buckets)
    each = each.withColumn("_sum", of("b1") + of("b2")).withColumn("_n", F.col("b1").isNotNull().cast("int") + F.col("b2").isNotNull().cast("int"))
    return each.groupBy("_row").agg(*[F.first(c).alias(c) for c in keep], F.try_divide(F.sum("_sum"), F.sum("_n")).alias("score"))


def judge(docs: DataFrame, labels: DataFrame, *, buckets: int = 1 << 16, smooth: float = 1.0, trusted: int | None = None, lost: float = 0.01, seed: int = 5) -> DataFrame:
    """Base counts and verdict of every row of ``docs`` (doc_id, text).

    Learned from are all documents labelled quality 1 (with ``trusted``, only
    so many with the least seeded hashes): three quarters by hash are the
    target, and all others set the threshold, the score below which a share of
    ``lost`` of them lies. The raw corpus is all of ``docs``. kept is false if
    a base rule fails (fewer than 50 words, or more than half of them in
    repeated windows of 3), else whether the mean log ratio of the text's
    n-grams reaches the threshold. A word counts in two n-grams: alone, and
    with the word after it.

    Nulls: a null text has no words and fails; a null doc_id or label is never
    trusted. Repeated rows are judged alike and kept as rows. Without trusted
    documents every ratio is 0, and the base rules alone decide. Empty input
    gives no rows. Texts are read whole. Other columns of ``docs`` are not
    looked at.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, score (null without words).
    """
    docs = docs.select("doc_id", "text")
    good = labels.where("quality = 1 and doc_id is not null").groupBy("doc_id").agg(F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    if trusted is not None:
        good = good.orderBy("h", "doc_id").limit(trusted)
    # texts stay where they are: rows are marked, and only counts and scores move
    docs = marked_members(docs, good, "doc_id", "_good").withColumn("aside", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(4)) == 0)
    marked = docs.select("doc_id", "text", (F.col("_good") & ~F.col("aside")).alias("target"), (F.col("_good") & F.col("aside")).alias("aside"))
    ratios = materialize(log_ratios(marked, buckets, smooth), "rules-ratios").scalar()
    base = base_counts(marked.withColumn("_row", F.monotonically_increasing_id()))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = materialize(scored(base, ["doc_id", "aside", *counts], ratios, buckets), "rules-scores")
    least = F.lit((quantiles(out.where("aside"), "score", [lost]) or [0.0])[0])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.select("doc_id", *counts, "base_failed", (~F.col("base_failed") & F.coalesce(F.col("score") >= least, F.lit(False))).alias("kept"), "score")


def op5_quality_rules(spark, sf_dir):
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
