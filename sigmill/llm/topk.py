"""Exact top-k inner products by a bit-sliced index.

Rows are dealt to blocks. A block holds, for every attribute, the bits of its
quantised values as bitmaps over the rows (slices). For a batch of queries the
slices are added with bitmap arithmetic (full adders on whole bitmaps), each
as often as the query's quantised weight says, which leaves the slices of all
scores. From the most significant slice downward these give the k-th highest
quantised score of each query; rows that the quantisation might have put on
the wrong side of it are resolved by exact integer products. What a query has
found in earlier blocks bounds later ones: rows that cannot reach its k-th
best are left out by the same slices, whole blocks by the lengths of vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_count

#: Rows of an index; rows and queries that meet in a task.
BLOCK, ROWS, QUERIES = 1 << 12, 1 << 16, 1 << 14
_U = np.uint64


def pack_bits(flags: np.ndarray) -> np.ndarray:
    """Booleans (..., n) to bitmaps (..., ceil(n / 64)) of 64-bit words."""
    pad = -flags.shape[-1] % 64
    if pad:
        flags = np.concatenate([flags, np.zeros((*flags.shape[:-1], pad), bool)], axis=-1)
    return np.packbits(flags, axis=-1, bitorder="little").view(np.uint64)


def unpack_bits(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


class Quantised:
    """Integers as value ~ unit * code, codes of at most ``bits`` bits, and the error's length."""

    def __init__(self, values: np.ndarray, bits: int):
        most = float(np.abs(values).max()) if values.size else 0.0
        self.unit = max(1.0, np.ceil(most / ((1 << bits) - 1)))
        self.codes = np.rint(values / self.unit).astype(np.int64)
        error = values - self.unit * self.codes
        self.error = np.sqrt((error**2).sum(-1))
        self.norm = np.sqrt((values**2).sum(-1))


class Index:
    """Bit slices of a block of integer vectors (rows, attributes)."""

    def __init__(self, values: np.ndarray, bits: int = 6):
        self.values = values
        self.q = Quantised(values, bits)
        self.low = self.q.codes.min(0) if len(values) else np.zeros(values.shape[1], np.int64)
        level = self.q.codes - self.low  # from 0 up
        self.top = level.max(0) if len(values) else self.low
        self.depth = [int(t).bit_length() for t in self.top]
        self.slices = [[pack_bits(level[:, i] >> b & 1 == 1) for b in range(d)] for i, d in enumerate(self.depth)]
        self.all = pack_bits(np.ones(len(values), bool))

    def scores(self, codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Slices, least first, of sum |code| * level' for queries (n, attributes), and what to add.

        level' is the level where the code is positive and top - level where it
        is negative (slices of all ones minus level), so all terms add up from 0.
        """
        waiting: list[list[np.ndarray]] = []
        size, plus = np.abs(codes), np.zeros(len(codes), np.int64)
        shape = (len(codes), len(self.all))

        def add(place: int, bitmap: np.ndarray) -> None:
            while True:
                while len(waiting) <= place:
                    waiting.append([])
                at = waiting[place]
                at.append(bitmap)
                if len(at) < 3:
                    return
                a, b, c = at
                half = a ^ b
                waiting[place] = [half ^ c]
                bitmap, place = (a & b) | (half & c), place + 1

        for i, slices in enumerate(self.slices):
            full = (1 << self.depth[i]) - 1
            minus = codes[:, i] < 0
            # code * level = |code| * level, or |code| * (full - level) - |code| * full
            plus += codes[:, i] * self.low[i] - np.where(minus, size[:, i] * full, 0)
            flip = np.where(minus, ~_U(0), _U(0))[:, None]
            for b, bitmap in enumerate(slices):
                turned = bitmap[None, :] ^ flip
                for c in range(int(size[:, i].max()).bit_length() if len(codes) else 0):
                    mask = np.where(size[:, i] >> c & 1 == 1, ~_U(0), _U(0))[:, None]
                    if mask.any():
                        add(b + c, turned & mask)
        out, place, carry = [], 0, None
        while place < len(waiting) or carry is not None:
            some = list(waiting[place]) if place < len(waiting) else []
            if carry is not None:
                some.append(carry)
            zero = np.zeros(shape, np.uint64)
            a, b, c = (*some, zero, zero, zero)[:3]
            half = a ^ b
            out.append(half ^ c)
            carry = (a & b) | (half & c) if len(some) > 1 else None
            place += 1
        return out, plus

    def search(self, queries: np.ndarray, own: list[np.ndarray], k: int, least: np.ndarray) -> list[np.ndarray]:
        """Rows that may be among the k best of each query and reach ``least``; own[q]: rows that take no part."""
        q = Quantised(queries, self.bits)
        slices, plus = self.scores(q.codes)
        n = len(self.values)
        alive = np.repeat(self.all[None, :], len(queries), 0)
        for j, some in enumerate(own):
            for r in some:
                alive[j, r >> 6] &= ~(_U(1) << _U(r & 63))
        counts = np.bitwise_count(alive).sum(1).astype(np.int64)
        # the k-th highest score, bit by bit from the top: rows above it, rows level with it
        above, level = np.zeros_like(alive), alive.copy()
        kth = np.zeros(len(queries), np.int64)
        for p in range(len(slices) - 1, -1, -1):
            ones = above | (level & slices[p])
            enough = np.bitwise_count(ones).sum(1) >= k
            kth += np.where(enough, 1 << p, 0)
            level = np.where(enough[:, None], level & slices[p], level & ~slices[p])
            above = np.where(enough[:, None], above, ones)
        # a row's exact score is off by at most |q| |row error| + |q error| |row code|
        unit = self.q.unit * q.unit
        off = q.norm * self.q.error.max(initial=0.0) + q.error * (self.q.norm + self.q.error).max(initial=0.0)
        floor = np.where(counts <= k, 0, kth - np.ceil(2 * off / unit).astype(np.int64) - 1)
        reach = np.ceil(np.maximum((least - off) / unit, -(2.0**60))).astype(np.int64) - plus - 1
        floor = np.maximum(0, np.maximum(floor, reach))
        alive[floor >= 1 << len(slices)] = 0
        # rows with at least that score, by comparing slices with its bits
        more, same = np.zeros_like(alive), alive.copy()
        for p in range(len(slices) - 1, -1, -1):
            bit = (floor >> p & 1 == 1)[:, None]
            more = np.where(bit, more, more | (same & slices[p]))
            same = np.where(bit, same & slices[p], same & ~slices[p])
        fit = more | same
        return [np.flatnonzero(unpack_bits(x, n)) for x in fit]

    bits = 6


def top_k(query_rows: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int, block: int = BLOCK, batch: int = 64):
    """Exact (query row, id, score) of the k best rows for each query.

    ``query_rows`` and ``rows`` number the rows of the input, so that a query
    does not meet itself; ``block`` rows at a time are indexed.
    """
    best: list[list[tuple[int, int]]] = [[] for _ in queries]  # (-score, id), ascending
    least = np.full(len(queries), -np.inf)
    norm = np.sqrt((queries.astype(float) ** 2).sum(1))
    for at in range(0, len(values), block):
        index = Index(values[at : at + block])
        names, numbers = ids[at : at + block], rows[at : at + block]
        order = np.argsort(numbers, kind="stable")
        open_ = np.flatnonzero(norm * index.q.norm.max(initial=0.0) * (1 + 1e-9) + 1 >= least)
        for lo in range(0, len(open_), batch):
            some = open_[lo : lo + batch]
            left, right = (np.searchsorted(numbers[order], query_rows[some], side) for side in ("left", "right"))
            own = [order[a:b] for a, b in zip(left, right)]
            for j, fit in zip(some.tolist(), index.search(queries[some], own, k, least[some])):
                if len(fit):
                    score = index.values[fit] @ queries[j]
                    top = np.lexsort((names[fit], -score))[:k]
                    best[j] = sorted(best[j] + [(-int(score[i]), int(names[fit[i]])) for i in top])[:k]
                    if len(best[j]) == k:
                        least[j] = -best[j][-1][0]
    return [(int(row), name, -score) for row, some in zip(query_rows, best) for score, name in some]


def quantise(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and v (array of long): floor(scale * x) of each component, without unusable rows."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return vectors.where(good).select("vec_id", F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def search(vectors: DataFrame, *, every: int = 50, k: int = 5, scale: int = 256, block: int = BLOCK, rows_a_task: int = ROWS, queries_a_task: int = QUERIES) -> DataFrame:
    """The k best rows of ``vectors`` (vec_id, embedding) for each query, by integer inner product.

    Queries: rows whose vec_id is divisible by ``every``; candidates: every
    row but the query's own, rows that repeat its vec_id included; ties go to
    the smaller vec_id; fewer than k rows give fewer results. Queries that
    share a vec_id each have results. Vectors that are null or hold a null or
    non-finite component, or have a null vec_id, take no part; vectors of
    different lengths are compared as if padded with zeros. Raises ValueError
    if a score might exceed 62 bits. Other columns are not looked at. Empty
    input gives no rows.

    Rows are dealt by a hash to groups of about ``rows_a_task`` (fewer where
    that leaves tasks idle), queries to groups of ``queries_a_task``, and each
    pair of groups is a task's work: it indexes ``block`` rows at a time.

    Returns query_id, rank (from 1), vec_id, score.
    """
    rows = materialize(quantise(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    n, width, most, queries = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(most), F.count_if(F.pmod("vec_id", F.lit(every)) == 0)).first()
    width = int(width or 0)
    if width * float(most or 0) ** 2 >= 2.0**62:
        raise ValueError("components are too large for 62-bit scores")
    groups = max(1, -(-n // rows_a_task), min(-(-n // block), shuffle_count(vectors.sparkSession)))
    batches = max(1, -(-queries // queries_a_task))
    of = lambda many, salt: F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(many)).cast("int")
    every_one = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    dealt = rows.select("row", "vec_id", "v", of(groups, 1).alias("group"), every_one(batches).alias("batch"))
    asked = asked.select("row", "v", of(batches, 2).alias("batch"), every_one(groups).alias("group"))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat, size = column.combine_chunks(), len(column)
        flat = flat if isinstance(flat, pa.ListArray) else pa.concat_arrays(column.chunks)
        lengths = np.diff(flat.offsets.to_numpy())
        values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if (lengths == width).all():
            return values.reshape(size, width)
        out = np.zeros((size, width), np.int64)
        out[np.repeat(np.arange(size), lengths), np.concatenate([np.arange(i) for i in lengths]) if size else []] = values
        return out

    def solve(table: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if table.num_rows and queries.num_rows:
            found = top_k(queries.column("row").to_numpy(), matrix(queries.column("v")), table.column("row").to_numpy(), table.column("vec_id").to_numpy(), matrix(table.column("v")), k, block)
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("row", "vec_id", "score"), columns)})

    best = dealt.groupBy("group", "batch").cogroup(asked.groupBy("group", "batch")).applyInArrow(solve, "row long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = rows.select("row", F.col("vec_id").alias("query_id"))
    return best.join(names, "row").select("query_id", "rank", "vec_id", "score")


def op3_topk(spark, sf_dir):
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
long AS (SELECT r, vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM v),
scored AS (SELECT q.r AS qr, q.vec_id AS query_id, c.r AS cr, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
           FROM long q JOIN long c ON q.i = c.i AND q.r <> c.r WHERE q.vec_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
