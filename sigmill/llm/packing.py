"""Packing token sequences: best fit, then swaps between underfull bins."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, row_key
from .tokens import Encoder

#: Pieces that one task packs together. Each group wastes less than a bin.
GROUP = 1 << 13


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; bins are lists of piece numbers."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        above = some >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                some &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        by_room[room - n].append(b)
        some |= 1 << (room - n)
    return bins


def _exchange(give: list[tuple[int, int]], take: list[tuple[int, int]], room: int):
    """Pieces to pass from one bin to a fuller one, and back, so that it gains most.

    ``give`` and ``take`` are sorted (length, piece). Tries a move, one for
    one, two for one and one for two; the gain is above 0 and at most ``room``.
    """
    best, found = 0, None

    def fit(want: int):  # the largest in ``give`` up to ``want``
        at = bisect_right(give, (want, 1 << 62)) - 1
        return give[at] if at >= 0 else None

    backs = [(0, ())] + [(n, ((n, i),)) for n, i in take]
    backs += [(take[a][0] + take[b][0], (take[a], take[b])) for a in range(min(len(take), 24)) for b in range(a)]
    for back, pieces in backs:
        if (x := fit(room + back)) and x[0] - back > best:
            best, found = x[0] - back, ((x,), pieces)
        if best == room:
            return found
    for back, pieces in backs[: 1 + len(take)]:  # two out, none or one back
        lo, hi = 0, len(give) - 1
        while lo < hi:
            gain = give[lo][0] + give[hi][0] - back
            if gain > room:
                hi -= 1
                continue
            if gain > best:
                best, found = gain, ((give[lo], give[hi]), pieces)
            lo += 1
        if best == room:
            break
    return found


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, effort: int = 64) -> list[list[int]]:
    """Exchange pieces between underfull bins, raising the sum of squared fills, until bins empty.

    The emptiest bin gives to fuller ones, fullest first; every exchange makes
    the fuller of two bins fuller still, so the sum grows and the search ends.
    ``effort`` bounds the exchanges for each underfull bin.
    """
    least = -(-sum(lengths) // capacity)
    packed = [sorted((lengths[i], i) for i in b) for b in bins]
    fill = [sum(n for n, _ in b) for b in packed]
    open_ = sorted((f, b) for b, f in enumerate(fill) if f < capacity)
    left = effort * len(open_)
    count = len(packed)
    stuck: list[tuple[int, int]] = []
    while len(open_) > 1 and count > least and left > 0:
        f, b = open_.pop(0)
        moved = False
        for k in range(len(open_) - 1, max(-1, len(open_) - 1 - 4 * effort), -1):
            g, c = open_[k]
            if not (found := _exchange(packed[b], packed[c], capacity - g)):
                continue
            there, back = found
            for x in there:
                packed[b].remove(x)
                insort(packed[c], x)
            for x in back:
                packed[c].remove(x)
                insort(packed[b], x)
            gain = sum(n for n, _ in there) - sum(n for n, _ in back)
            fill[b] -= gain
            fill[c] += gain
            del open_[k]
            if fill[c] < capacity:
                insort(open_, (fill[c], c))
            moved = True
            left -= 1
            break
        if not fill[b]:
            count -= 1
        elif moved:
            insort(open_, (fill[b], b))
        else:
            stuck.append((f, b))
    return [[i for _, i in b] for b in packed if b]


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens: the first takes what is over."""
    first = n % capacity if n > capacity else n
    return ([first] if first else []) + [capacity] * ((n - first) // capacity)


def pieces(docs: DataFrame, tokenizer: str, *, spaces: bool, end_id: int, capacity: int, with_ids: bool) -> DataFrame:
    names = ["key", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]

    def run(batches):
        model = None
        for b in batches:
            model = model or Encoder(tokenizer, spaces)
            keys, doc_ids, texts = (b.column(i).to_pylist() for i in range(3))
            for lo in range(0, len(keys), 256):
                rows = []
                for key, doc, got in zip(keys[lo : lo + 256], doc_ids[lo : lo + 256], model.encode(texts[lo : lo + 256])):
                    ids, start = np.append(got, np.uint32(end_id)).astype("<u4"), 0
                    for k, n in enumerate(cut(len(ids), capacity)):
                        part = ids[start : start + n]
                        rows.append((key, doc, k, start, n, zlib.crc32(part.tobytes()), part.astype(np.int64) if with_ids else None))
                        start += n
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    out = docs.select(row_key("doc_id", "text").alias("key"), "doc_id", "text")
    return out.mapInArrow(run, "key long, doc_id long, piece int, start long, length long, ids_crc32 long, ids array<long>")


def pack_documents(docs: DataFrame, tokenizer: str, *, spaces: bool = True, end_id: int = 2, capacity: int = 1024, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """Sequences of at most ``capacity`` tokens that hold all documents.

    A document (doc_id, text) is its ids and ``end_id``; longer ones are cut
    into pieces of ``capacity``, the first of which takes the remainder. Full
    pieces are sequences of their own; the others are dealt by a hash to groups
    of about ``group`` pieces, and each group is packed by best fit and local
    search, so a group of copies or a hot source is spread like all else.

    Nulls: a null text is empty (its piece is ``end_id`` alone); a null doc_id
    is carried through. Repeated rows are packed once each. Empty input gives
    no rows. Other columns are not looked at.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    with ``with_ids`` the ids themselves.
    """
    cut_up = materialize(pieces(docs, tokenizer, spaces=spaces, end_id=end_id, capacity=capacity, with_ids=with_ids), "packing-pieces")
    groups = max(1, -(-cut_up.where(F.col("length") < capacity).count() // group))
    dealt = cut_up.withColumn("bin", F.pmod(F.xxhash64("key", "piece"), F.lit(groups)).cast("int"))

    def solve(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_pylist()
        g = table.column("bin")[0].as_py() if len(lengths) else 0
        open_ = [i for i, n in enumerate(lengths) if n < capacity]
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        bins = [[open_[j] for j in b] for b in pack([lengths[i] for i in open_], capacity)]
        bins += [[i] for i, n in enumerate(lengths) if n >= capacity]
        for b, some in enumerate(bins):
            at = 0
            for i in some:
                sequence[i], offset[i] = (g << 32) | b, at
                at += lengths[i]
        return table.drop_columns(["bin", "key"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<long>, sequence_id long, offset long"
    out = dealt.select("key", "bin", "doc_id", "piece", "start", "length", "ids_crc32", "ids").groupBy("bin").applyInArrow(solve, schema)
    return out if with_ids else out.drop("ids")


def op4_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
