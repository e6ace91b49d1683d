"""Which windows of fixed length occur more than once in a corpus, at scale.

A window of ``length`` symbols is filed under its canonical anchor: the gram
(a few symbols) inside it with the least hash. Equal windows have equal
anchors at equal places, and neighbouring windows mostly share theirs, so a
document files few anchors, each with the run of windows it stands for (its
context: the symbols those windows cover). Then

1. anchors that occur once in the corpus are dropped, by a count;
2. equal contexts (same anchor, same signature) are settled by counts alone,
   however many copies there are;
3. what is left, one context for each signature, is grouped by anchor and
   given to a solver that compares windows of different contexts;
4. contexts of an anchor with more of them than a solver should hold are cut
   into runs of windows that start at the same places relative to the anchor;
   a run is filed under the symbols that all its windows share, and goes
   through steps 2 and 3 again. What is still too much there is settled window
   by window, by counts of window hashes: exact, and free of large groups.

Keys that many rows share never meet in one task: rows are combined before
shuffles, and hot keys are joined by a broadcast of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import discard, join_unique, materialize, row_key, shuffle_count, split_by_keys, struct_of

#: Contexts of one anchor that a solver takes together; beyond, step 4. Windows of a run there.
GROUP_CAP = 1 << 15
RUN = 16
_SEGMENT = 1 << 20
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64) | 1 for i in range(64)], np.uint64)


_TYPES = {"symbols": pa.binary()} | dict.fromkeys(("lo", "span", "at", "from", "to", "p"), pa.int32())


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES.get(n, pa.int64())) for n, c in zip(names, zip(*rows))], names)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def byte_grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of ``gram`` bytes (a multiple of 8)."""
    data = np.ascontiguousarray(data)
    eight = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
    n = len(data) - gram + 1
    out = np.zeros(n, np.uint64)
    for j in range(0, gram, 8):
        out += _mix(eight[j : j + n]) * _ODD[j // 8]
    return _mix(out)


def symbol_grams(symbols: np.ndarray, gram: int) -> np.ndarray:
    n = len(symbols) - gram + 1
    out = np.zeros(n, np.uint64)
    for j in range(gram):
        out += symbols[j : j + n] * _ODD[j]
    return _mix(out)


def anchors(symbols: np.ndarray, grams: Callable, gram: int, width: int) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, place, first window, last window) of the anchors of all windows.

    ``width`` is the number of grams in a window; ties go to the leftmost.
    Long documents are hashed and searched in segments that share width - 1
    grams, so memory beyond the text itself is that of one segment.
    """
    mask = np.uint64(_SEGMENT - 1)
    count = len(symbols) - gram + 1
    for lo in range(0, max(0, count - width + 1), _SEGMENT - width + 1):
        part = grams(symbols[lo : lo + _SEGMENT + gram - 1], gram)
        m = (part & ~mask) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if width > span:
            m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
        place = (m & mask).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        last = np.concatenate((first[1:] - 1, [len(place) - 1]))
        yield part[place[first]], lo + place[first], lo + first, lo + last


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order, touching ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def runs(flags: np.ndarray, length: int, base: int = 0) -> list[tuple[int, int]]:
    """Spans covered by the windows whose start is flagged."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(base + int(a), base + int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2])]


class Windows:
    """A kind of window: how texts become symbols, and what counts as a repeat.

    to_symbols(text) gives an array (uint8 or uint64) in which one item is one
    symbol; ``earlier``: only a repeat of a smaller doc_id's window counts,
    else any other window; solve(group) gets the contexts of some anchors,
    sorted by anchor and doc_id, as (anchor, doc_id, symbols, windows, at) and
    yields for each a list of spans, in places of the context.
    """

    def __init__(self, length: int, gram: int, earlier: bool, to_symbols: Callable, grams: Callable, solve: Callable):
        self.length, self.gram, self.earlier, self.to_symbols, self.grams, self.solve = length, gram, earlier, to_symbols, grams, solve

    def file(self, docs: DataFrame) -> DataFrame:
        """One row per anchor: key, doc_id, a(nchor), s(ignature), lo, span (windows), at (place of the anchor)."""

        def run(batches):
            names = ["key", "doc_id", "a", "s", "lo", "span", "at"]
            for b in batches:
                out: list[list] = [[] for _ in names]
                size = 0
                for key, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    if text is None or len(text) * 4 < self.length:
                        continue
                    x = self.to_symbols(text)
                    if len(x) < self.length:
                        continue
                    for value, place, first, last in anchors(x, self.grams, self.gram, self.length - self.gram + 1):
                        raw, w = x.tobytes(), x.itemsize
                        at = place - first
                        sign = [xxhash.xxh3_64_intdigest(raw[w * lo : w * hi], k) for lo, hi, k in zip(first.tolist(), (last + self.length).tolist(), at.tolist())]
                        n = len(first)
                        for column, values in zip(out, (np.full(n, key), np.full(n, doc), value.view(np.int64), np.array(sign, np.uint64).view(np.int64), first.astype(np.int32), (last - first + 1).astype(np.int32), at.astype(np.int32))):
                            column.append(values)
                        size += n
                    if size > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)
                        out, size = [[] for _ in names], 0
                if size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)

        rows = docs.select(row_key("doc_id", "text").alias("key"), "doc_id", "text").where("text is not null")
        # without an order among documents their ids don't matter; with one, a null has no place in it
        rows = rows.where("doc_id is not null") if self.earlier else rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")))
        return rows.mapInArrow(run, "key long, doc_id long, a long, s long, lo int, span int, at int")

    def contexts(self, docs: DataFrame, wanted: DataFrame) -> DataFrame:
        """Symbols of the contexts in ``wanted`` (one row for each a, s)."""
        per = wanted.groupBy("key").agg(F.collect_list(F.struct("a", "s", "lo", "span", "at")).alias("wants"))
        rows, _ = split_by_keys(docs.select(row_key("doc_id", "text").alias("key"), "doc_id", "text"), wanted, "key")
        rows = rows.join(per, "key")

        def run(batches):
            names = ["a", "s", "key", "doc_id", "lo", "span", "at", "symbols"]
            for b in batches:
                out: list[tuple] = []
                for key, doc, text, wants in zip(*(b.column(i).to_pylist() for i in range(4))):
                    x = self.to_symbols(text)
                    for q in wants:
                        out.append((q["a"], q["s"], key, doc, q["lo"], q["span"], q["at"], x[q["lo"] : q["lo"] + q["span"] - 1 + self.length].tobytes()))
                    if len(out) > 2000:
                        yield _batch(out, names)
                        out = []
                if out:
                    yield _batch(out, names)

        rows = rows.select("key", F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), "text", "wants")
        return rows.mapInArrow(run, "a long, s long, key long, doc_id long, lo int, span int, at int, symbols binary")

    def _solved(self, contexts: DataFrame) -> DataFrame:
        """a, s, key, doc_id, lo, spans of contexts in which the solver found repeats."""
        spark = contexts.sparkSession
        laid = contexts.repartition(shuffle_count(spark), "a").sortWithinPartitions("a", "doc_id", "s")
        names = ["a", "s", "key", "doc_id", "lo", "from", "to"]

        def run(batches):
            held: list[tuple] = []
            size, seen = 0, None

            def flush():
                found = []
                given = [(h[0], h[3], h[7], h[5], h[6]) for h in held]
                for h, spans in zip(held, self.solve(given)):
                    found += [(*h[:5], h[4] + a, h[4] + b) for a, b in spans]
                if found:
                    yield _batch(found, names)

            for b in batches:
                for row in zip(*(b.column(i).to_pylist() for i in range(8))):
                    if (row[0], row[1]) == seen:  # repeated rows of the input bring a context twice
                        continue
                    if held and row[0] != held[-1][0] and size > 1 << 20:
                        yield from flush()
                        held, size = [], 0
                    held.append(row)
                    size += len(row[7])
                    seen = (row[0], row[1])
            if held:
                yield from flush()

        cols = ["a", "s", "key", "doc_id", "lo", "span", "at", "symbols"]
        return laid.select(*cols).mapInArrow(run, 'a long, s long, key long, doc_id long, lo int, `from` int, `to` int')

    def _one_by_one(self, contexts: DataFrame) -> DataFrame:
        """The same for anchors with too many contexts, from counts of window hashes."""
        names = ["a", "s", "key", "doc_id", "lo", "p", "w1", "w2"]

        def run(batches):
            for b in batches:
                w = self.length
                for a, s, key, doc, lo, span, _, data in zip(*(b.column(i).to_pylist() for i in range(8))):
                    item = len(data) // (span - 1 + w)
                    h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[item * p : item * (p + w)]) for p in range(span)), np.int64).reshape(-1, 2)
                    full = lambda v, t=np.int64: pa.array(np.full(span, v, t))
                    yield pa.RecordBatch.from_arrays([full(a), full(s), full(key), full(doc), full(lo, np.int32), pa.array(np.arange(lo, lo + span, dtype=np.int32)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names)

        cols = ["a", "s", "key", "doc_id", "lo", "span", "at", "symbols"]
        once = contexts.dropDuplicates(["a", "s"]).select(*cols)
        rows = materialize(once.mapInArrow(run, "a long, s long, key long, doc_id long, lo int, p int, w1 long, w2 long"), "windows-single")
        on = ["a", "w1", "w2"]
        seen = materialize(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where("n > 1"), "windows-counts")
        met = join_unique(rows, seen, on, "n", rows.count())
        met = met.where(F.col("doc_id") > F.col("least")) if self.earlier else met
        return met.select("a", "s", "key", "doc_id", "lo", F.col("p").alias("from"), (F.col("p") + self.length).cast("int").alias("to"))

    def _split(self, contexts: DataFrame, cap: int) -> DataFrame:
        """The same for anchors with too many contexts, by runs of windows; see step 4."""
        some = materialize(contexts.dropDuplicates(["a", "s"]).withColumn("context", F.xxhash64("a", "s")), "windows-large")
        names = ["key", "doc_id", "a", "s", "lo", "span", "at"]
        cols = ["context", "doc_id", "a", "lo", "span", "at", "symbols"]

        def cut(batches):
            w = self.length
            for b in batches:
                out: list[tuple] = []
                for context, doc, a, lo, span, at, data in zip(*(b.column(i).to_pylist() for i in range(7))):
                    item, p = len(data) // (span - 1 + w), 0
                    while p < span:
                        k = (p - at) // RUN
                        end = min(span, (k + 1) * RUN + at)
                        common = data[item * ((k + 1) * RUN - 1 + at) : item * (k * RUN + at + w)]
                        filed = xxhash.xxh3_64_intdigest(common, (a ^ (k * 0x9E3779B97F4A7C15)) & ((1 << 64) - 1))
                        sign = xxhash.xxh3_64_intdigest(data[item * p : item * (end - 1 + w)], (p - at) & 0xFFFF)
                        out.append((context, doc, filed - (1 << 63), sign - (1 << 63), lo + p, end - p, at - p))
                        p = end
                if out:
                    yield _batch(out, names)

        rows = materialize(some.select(*cols).mapInArrow(cut, "key long, doc_id long, a long, s long, lo int, span int, at int"), "windows-runs")

        def fetch(wanted: DataFrame) -> DataFrame:
            per = wanted.groupBy(F.col("key").alias("context")).agg(F.collect_list(F.struct("a", "s", "lo", "span", "at")).alias("wants"))
            given = some.select("context", "doc_id", F.col("lo").alias("base"), "span", "symbols").join(per, "context")

            def run(batches):
                for b in batches:
                    out: list[tuple] = []
                    for context, doc, base, span, data, wants in zip(*(b.column(i).to_pylist() for i in range(6))):
                        item = len(data) // (span - 1 + self.length)
                        for q in wants:
                            first = q["lo"] - base
                            out.append((q["a"], q["s"], context, doc, q["lo"], q["span"], q["at"], data[item * first : item * (first + q["span"] - 1 + self.length)]))
                    if out:
                        yield _batch(out, ["a", "s", "key", "doc_id", "lo", "span", "at", "symbols"])

            return given.mapInArrow(run, "a long, s long, key long, doc_id long, lo int, span int, at int, symbols binary")

        spans = self._settle(rows, fetch, cap, last=True).withColumnRenamed("key", "context")
        return spans.join(some.select("context", "a", "s", "key", "doc_id", "lo"), "context").select("a", "s", "key", "doc_id", "lo", "from", "to")

    def repeats(self, docs: DataFrame, cap: int = GROUP_CAP) -> DataFrame:
        """key, spans (array of from, to in symbols) of rows with repeated windows."""
        filed = materialize(self.file(docs), "windows-anchors")
        often = materialize(filed.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "windows-often")
        rows = materialize(join_unique(filed, often, ["a"], "n", filed.count()).drop("n"), "windows-rows")
        discard(filed, often)
        spans = self._settle(rows, lambda wanted: self.contexts(docs, wanted), cap)
        return spans.groupBy("key").agg(F.collect_set(F.struct("from", "to")).alias("spans"))

    def _settle(self, rows: DataFrame, fetch: Callable[[DataFrame], DataFrame], cap: int, last: bool = False) -> DataFrame:
        """key, from, to of repeated windows; ``rows`` as from ``file``, ``fetch`` gives the symbols of some of them."""
        total = rows.count()
        signed = materialize(rows.groupBy("a", "s").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "key", "lo", "span", "at")).alias("one")), "windows-signed")
        kinds = materialize(signed.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "windows-kinds")
        wanted = join_unique(signed, kinds, ["a"], "k", total).select("a", "s", "k", "one.*")
        wanted = materialize(wanted.drop("doc_id", "k"), "windows-wanted")
        contexts = materialize(fetch(wanted), "windows-contexts")
        discard(wanted)
        large = kinds.where(F.col("k") > cap).select("a")
        if large.isEmpty():
            found = self._solved(contexts)
        else:
            # few: each has more than ``cap`` of the contexts, yet not bounded, so no broadcast is forced
            hot = contexts.join(large, "a", "left_semi")
            found = self._solved(contexts.join(large, "a", "left_anti")).unionByName(self._one_by_one(hot) if last else self._split(hot, cap))
        # where equal contexts settle it
        copies = join_unique(rows, signed.where("n > 1").select("a", "s", "n", "least"), ["a", "s"], "n", total)
        whole = copies.where(F.col("doc_id") > F.col("least")) if self.earlier else copies
        spans = whole.select("key", F.col("lo").alias("from"), (F.col("lo") + F.col("span") - 1 + self.length).cast("int").alias("to"))
        if not self.earlier:
            return spans.unionByName(found.select("key", "from", "to"))
        # a document may hold the context several times; all take what was found for one
        found = materialize(found, "windows-found")
        each = found.groupBy("a", "s").agg(F.collect_list(F.struct((F.col("from") - F.col("lo")).alias("f"), (F.col("to") - F.col("lo")).alias("t"))).alias("rel"))
        each = materialize(each.join(signed.select("a", "s", "n", "least"), ["a", "s"]), "windows-each")
        same = join_unique(rows, each, ["a", "s"], "n", total).where(F.col("doc_id") == F.col("least"))
        same = same.select("key", "lo", F.explode("rel").alias("r"))
        return spans.unionByName(same.select("key", (F.col("lo") + F.col("r.f")).cast("int").alias("from"), (F.col("lo") + F.col("r.t")).cast("int").alias("to")))


def with_spans(docs: DataFrame, spans: DataFrame, keep: list[str], result: str, cut: Callable) -> DataFrame:
    """cut(text, merged spans) -> tuple for every row of ``docs``; ``keep``: columns carried through."""
    fields = [f for f in docs.schema.fields if f.name in keep]
    given = docs.select(row_key("doc_id", "text").alias("_key"), F.col("text").alias("_text"), struct_of(keep).alias("_kept"))
    spans = materialize(spans.select(F.col("key").alias("_key"), "spans"), "windows-spans")
    maybe, never = split_by_keys(given, spans.select("_key"), "_key")
    joined = maybe.join(spans, "_key", "left").select("_kept", "_text", "spans").unionByName(never.select("_kept", "_text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))
    names = [f.name for f in fields] + [x.split()[0] for x in result.split(", ")]
    if len(set(names)) < len(names):
        raise ValueError(f"columns to keep clash with results: {names}")

    def run(batches):
        for b in batches:
            kept = b.column(0)
            texts, spans = b.column(1).to_pylist(), b.column(2).to_pylist()
            rows = [cut(t, merge((s["from"], s["to"]) for s in some or ())) for t, some in zip(texts, spans)]
            found = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([kept.field(f.name) for f in fields] + found, names)

    types = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in result.split(", ")]
    kinds = {"long": LongType(), "string": StringType()}
    schema = StructType([*fields, *[StructField(x.split()[0], kinds[x.split()[1]]) for x in result.split(", ")]])
    return joined.mapInArrow(run, schema)
