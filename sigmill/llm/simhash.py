"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is looked at in parts so small that two fingerprints
within the threshold differ in few bits of at least one part. On a part, the
words of a covering code are the anchors: a product of perfect Hamming codes
[7,4] (covering radius 1 on 7 bits) and of plain bits (radius 0). A
fingerprint's home is the code word that covers it, and it is replicated to
every anchor that can be home to a fingerprint within the part's threshold.
Each pair within the threshold so meets at the home of either one, and only
homes are compared with the others there.

Anchors that agree in their first blocks form a cell. A fingerprint travels
once to each cell that holds an anchor of its, in packed arrays, and is
replicated to the anchors of the cell where it arrives.

A wide radius (two fingerprints and a size) has about as many cells as anchors
once cells are small, so cells stay large there: a fingerprint travels to few of
them, slices by size bound what a cell holds, and the anchors of a cell are
gone through depth first, so that they are never laid out all at once.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, row_key, shuffle_count, split_by_keys, struct_of
from .graph import components

SEED = 42
#: Fingerprints that a cell holds, about; a cell with more than twice as many is split.
CELL = 1 << 17
#: With sizes: a slice holds about so many times CELL fingerprints, and cells are cut finer than parts while a fingerprint's copies stay within so many bytes.
SLICE, TRAVEL = 8, 3000
#: Cost of a comparison there, in anchors that a fingerprint is replicated to.
COMPARE = 0.02
_U = np.uint64


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words (of all words, if fewer), A-Z lower-cased."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashed, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return np.array([hashed(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([hashed(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())], np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits set in over half of ``h``; 0 for none."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int) -> int:
    return majority(shingle_hashes(text, shingle))


def scatter(h: np.ndarray) -> np.ndarray:
    """Other hashes of the same things, for a second fingerprint."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) per row of ``docs``."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


@cache
def _code() -> tuple[list[int], list[int], list[list[tuple[int, int]]]]:
    """The [7,4] Hamming code: its words, the home of each value, and for each value the words in reach.

    A word is in reach of a value at d flips if so many, and no fewer, give a
    value at home there; the list has (d, word), ascending.
    """
    words = [w for w in range(128) if not np.bitwise_xor.reduce([i + 1 for i in range(7) if w >> i & 1] or [0])]
    home = [min(words, key=lambda c: ((c ^ v).bit_count(), c)) for v in range(128)]
    reach = [sorted((min((v ^ x).bit_count() for x in range(128) if home[x] == c), c) for c in words) for v in range(128)]
    return words, home, reach


@cache
def _options(size: int, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in reach of every value of a block within ``budget``: first of each value, flips, words."""
    lists = [[(d, c) for d, c in some if d <= budget] for some in (_code()[2] if size == 7 else [[(0, 0), (1, 1)], [(0, 1), (1, 0)]])]
    first = np.cumsum([0, *map(len, lists)])
    return first, np.array([d for some in lists for d, _ in some]), np.array([c for some in lists for _, c in some], np.uint64)


@cache
def _mean_reach(size: int) -> list[float]:
    """How many words are in reach of a value of a block at 0, 1, 2 ... flips, on average."""
    lists = _code()[2] if size == 7 else [[(0, 0), (1, 1)]]
    return [sum(d == k for some in lists for d, _ in some) / len(lists) for k in range(8)]


class Cover:
    """Anchors on ``bits`` bits: ``codes`` Hamming blocks, then plain bits; ``threshold``: flips within the part."""

    def __init__(self, bits: int, codes: int, threshold: int):
        self.sizes = [7] * codes + [1] * (bits - 7 * codes)
        self.threshold = threshold

    def homes(self, x: np.ndarray) -> np.ndarray:
        """Home anchor of each value (uint64), a number of its own."""
        out, at, home = np.zeros(len(x), np.uint64), 0, np.array(_code()[1], np.uint64)
        for s in self.sizes:
            block = (x >> _U(at)) & _U((1 << s) - 1)
            out |= (home[block] if s == 7 else block) << _U(at)
            at += s
        return out

    def anchors(self, x: np.ndarray, blocks: int | None = None, prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, flips) of every anchor that is home to some value within the threshold of x.

        With ``blocks``: on so many first blocks alone, which gives the cells;
        with ``prefix`` too: the anchors on all blocks of that cell.
        """
        row, anchor, used, at = np.arange(len(x)), np.zeros(len(x), np.uint64), np.zeros(len(x), np.int64), 0
        for k, s in enumerate(self.sizes if prefix is not None else self.sizes[:blocks]):
            first, flips, words = _options(s, self.threshold)
            block = ((x[row] >> _U(at)) & _U((1 << s) - 1)).astype(np.int64)
            many = first[block + 1] - first[block]
            who = np.repeat(np.arange(len(row)), many)
            option = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + first[block][who]
            now = used[who] + flips[option]
            fits = now <= self.threshold
            if prefix is not None and k < blocks:
                fits &= words[option] == (prefix[row[who]] >> _U(at)) & _U((1 << s) - 1)
            who, option = who[fits], option[fits]
            row, anchor, used = row[who], anchor[who] | words[option] << _U(at), now[fits]
            at += s
        return row, anchor, used

    def groups(self, x: np.ndarray, homes: np.ndarray, others: np.ndarray, blocks: int, prefix: int):
        """(rows, which of them are at home) of each anchor of the cell with a home and another row, one at a time.

        ``homes`` and ``others`` tell which rows count at their home, and which
        elsewhere. Rows keep their order. Depth first: what is held is a few
        bytes a row for each block.
        """

        def walk(k: int, at: int, row: np.ndarray, used: np.ndarray):
            if k == len(self.sizes):
                yield row, (used == 0) & homes[row]
                return
            s = self.sizes[k]
            block = ((x[row] >> _U(at)) & _U((1 << s) - 1)).astype(np.intp)
            for word in self._words(s) if k >= blocks else [(prefix >> at) & ((1 << s) - 1)]:
                now = used + self._flips(s)[word][block]
                fits = np.flatnonzero((now == 0) | (now <= self.threshold) & others[row])
                r, u = row[fits], now[fits]
                if len(r) > 1 and (homes[r] & (u == 0)).any():
                    yield from walk(k + 1, at + s, r, u)

        yield from walk(0, 0, np.arange(len(x), dtype=np.int32), np.zeros(len(x), np.uint8))

    @staticmethod
    @cache
    def _flips(size: int) -> dict[int, np.ndarray]:
        """By word of a block: the flips (64: never) after which each value may be at home there."""
        lists = _code()[2] if size == 7 else [[(0, 0), (1, 1)], [(0, 1), (1, 0)]]
        out = {w: np.full(1 << size, 64, np.uint8) for some in lists for _, w in some}
        for v, some in enumerate(lists):
            for d, w in some:
                out[w][v] = d
        return out

    @classmethod
    def _words(cls, size: int) -> list[int]:
        return sorted(cls._flips(size))

    def reach(self, blocks: int | None = None) -> float:
        """How many anchors a value is replicated to, on average."""
        have = [1.0] + [0.0] * self.threshold
        for s in self.sizes[:blocks]:
            each = _mean_reach(s)
            have = [sum(have[i] * each[d - i] for i in range(max(0, d - 7), d + 1)) for d in range(self.threshold + 1)]
        return sum(have)

    def count(self, blocks: int | None = None) -> int:
        return 2 ** sum(4 if s == 7 else 1 for s in self.sizes[:blocks])


def choose_cover(n: int, threshold: int, compare: float = 0.02) -> tuple[list[int], list[Cover], int]:
    """Parts (first bits), covers and first blocks of a cell for n fingerprints.

    Of all ways to cut 64 bits into parts, and parts into blocks of which one
    at least is a Hamming code, the one with the least work: fingerprints
    replicated, and ``compare`` for each that a home is compared with. Cells
    have about CELL fingerprints. This changes cost only: every choice finds
    all pairs.
    """
    best = None
    for parts in range(1, 9):
        bits = [64 // parts + (i < 64 % parts) for i in range(parts)]
        within = [(threshold + 1) // parts + (i < (threshold + 1) % parts) - 1 for i in range(parts)]
        if max(within) > 4 or min(within) < 0 or within.count(0) > 1:
            continue
        for codes in range(1, bits[-1] // 7 + 1):
            covers = [Cover(b, codes, t) for b, t in zip(bits, within)]
            work = sum(c.reach() * (1 + compare * n / c.count()) for c in covers)
            if best is None or work < best[0]:
                best = work, [sum(bits[:i]) for i in range(len(covers))], covers
    _, starts, covers = best
    blocks = next((k for k in range(1, len(covers[0].sizes)) if n * covers[0].reach(k) / covers[0].count(k) <= CELL), len(covers[0].sizes))
    return starts, covers, blocks


def _part(x: np.ndarray, at: int, cover: Cover) -> np.ndarray:
    return (x >> _U(at)) & _U((1 << sum(cover.sizes)) - 1)


def link_group(fp: np.ndarray, home: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges that join what is linked in one anchor's group: at most one per member.

    Homes are compared with all members in blocks; a home is joined once to
    each set it is not yet in, by that set's nearest member.
    """
    label = np.arange(len(fp))
    edges, mine = [], np.flatnonzero(home)
    block = max(1, min(256, (1 << 20) // max(1, len(fp))))
    for lo in range(0, len(mine), block):
        some = mine[lo : lo + block]
        apart = np.bitwise_count(fp[some][:, None] ^ fp[None, :])
        which, j = np.nonzero(apart <= threshold)
        far = apart[which, j].astype(np.int64)
        i = some[which]
        new = label[i] != label[j]
        i, j, far = i[new], j[new], far[new]
        order = np.lexsort((far, i))
        for u, v in zip(i[order].tolist(), j[order].tolist()):
            x, y = int(label[u]), int(label[v])
            if x != y:
                label[label == max(x, y)] = min(x, y)
                edges.append((u, v))
    return edges


def link_ordered(row: np.ndarray, fp: np.ndarray, home: np.ndarray, second: np.ndarray, size: np.ndarray, threshold: int, both: int, ratio: float, up: np.ndarray) -> list[tuple[int, int]]:
    """As ``link_group``, for members in order of size; a home is compared with later members only.

    The distances of both fingerprints together are at most ``both``, and the
    smaller size is at least ``ratio`` of the larger. ``row`` numbers the
    members in ``up``, the sets of rows joined so far (each row's parent),
    which goes on from group to group, and in the edges.
    """

    def root(x: int) -> int:
        while (y := up.item(x)) != x:
            up[x] = up[y]
            x = y
        return x

    edges, mine = [], np.flatnonzero(home)
    last = np.searchsorted(size, size[mine] / ratio + 1e-9, "right")
    lo = 0
    while lo < len(mine):
        hi = lo + max(1, min(256, (1 << 17) // max(1, int(last[lo] - mine[lo]))))
        some, a, b = mine[lo:hi], int(mine[lo]) + 1, int(last[min(hi, len(mine)) - 1])
        lo = hi
        if a >= b:
            continue
        apart = np.bitwise_count(fp[some][:, None] ^ fp[None, a:b])
        at = np.flatnonzero(apart <= threshold)
        i, j = some[at // (b - a)], at % (b - a) + a
        fits = (i < j) & (up[row[i]] != up[row[j]]) & (apart.ravel()[at] + np.bitwise_count(second[i] ^ second[j]) <= both) & (size[i] >= ratio * size[j])
        for u, v in zip(row[i[fits]].tolist(), row[j[fits]].tolist()):
            x, y = root(u), root(v)
            if x != y:
                up[max(x, y)] = min(x, y)
                edges.append((u, v))
    return edges


#: What travels of a fingerprint: itself, a second one, a size.
_ITEM = np.dtype([("fp", "<u8"), ("second", "<u8"), ("size", "<u4")])


def node(fp: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number (signed) for both fingerprints."""
    return (fp if second is None else scatter(fp ^ scatter(second))).view(np.int64)


def links(fps: DataFrame, threshold: int, both: int | None = None, ratio: float = 0.0) -> DataFrame:
    """Edges u, v between distinct fingerprints, enough to join all that are linked.

    ``fps`` has fp, and with ``both`` also second and size (see
    ``sized_links``). A cell that many fingerprints share is split: its homes
    and its others are dealt over rows and columns, and every pair of them is a
    cell of its own.
    """
    if both is not None:
        return sized_links(fps, threshold, both, ratio)
    n = fps.count()
    starts, covers, blocks = choose_cover(n, threshold)
    kind = np.dtype([("fp", "<u8")])
    fps = fps.select("fp")

    def items(b: pa.RecordBatch) -> np.ndarray:
        x = np.zeros(b.num_rows, kind)
        x["fp"] = b.column(0).to_numpy().view(np.uint64)
        return x

    def cells(x: np.ndarray):
        """(part, cell prefix, row) of every cell that a fingerprint goes to."""
        for part, (at, cover) in enumerate(zip(starts, covers)):
            row, prefix, _ = cover.anchors(_part(x["fp"], at, cover), blocks)
            yield part, prefix, row

    def sized(batches):
        for b in batches:
            for part, prefix, _ in cells(items(b)):
                some, many = np.unique(prefix, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), part, np.int32)), pa.array(some.view(np.int64)), pa.array(many)], ["part", "cell", "n"])

    # at most one cell for each CELL fingerprints that travel, and never more than 1024
    sizes = fps.mapInArrow(sized, "part int, cell long, n long").groupBy("part", "cell").agg(F.sum("n").alias("n"))
    large = {(r["part"], r["cell"]): -(-r["n"] // CELL) for r in sizes.where(F.col("n") > 2 * CELL).orderBy(F.col("n").desc(), "part", "cell").limit(1024).collect()}

    def dealt(batches):
        for b in batches:
            x = items(b)
            for part, prefix, row in cells(x):
                order = np.argsort(prefix, kind="stable")
                prefix, row = prefix[order], row[order]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(prefix)) + 1, [len(prefix)]))
                out = []
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    if lo == hi:
                        continue
                    cell, some = int(prefix[lo : lo + 1].view(np.int64)[0]), x[row[lo:hi]]
                    k = large.get((part, cell), 1)
                    if k == 1:
                        out.append((part, cell, 0, 3, some.tobytes()))
                        continue
                    own = (scatter(some["fp"] ^ _U(SEED)) % _U(k)).astype(np.int64)
                    for mine in range(k):
                        data = some[own == mine].tobytes()
                        for other in range(k if data else 0):  # 1: homes, 2: others, 3: both
                            out.append((part, cell, mine * k + other, 3 if mine == other else 1, data))
                            if mine != other:
                                out.append((part, cell, other * k + mine, 2, data))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["part", "cell", "salt", "roles", "data"])

    spread = max(shuffle_count(fps.sparkSession), 3 * len(covers) * min(covers[0].count(blocks), 1 << 16))
    laid = fps.mapInArrow(dealt, "part int, cell long, salt int, roles int, data binary").repartition(min(spread, max(shuffle_count(fps.sparkSession), n // 64)), "part", "cell", "salt").sortWithinPartitions("part", "cell", "salt")

    def solve(part: int, cell: int, held: list[tuple[int, bytes]]):
        x = np.concatenate([np.frombuffer(d, kind) for _, d in held])
        roles = np.concatenate([np.full(len(d) // kind.itemsize, r) for r, d in held])
        cover = covers[part]
        row, anchor, flips = cover.anchors(_part(x["fp"], starts[part], cover), blocks, np.full(len(x), cell, np.int64).view(np.uint64))
        use = np.where(flips == 0, roles[row] > 0, roles[row] & 2 > 0)
        home = (flips == 0) & (roles[row] & 1 > 0)
        row, anchor, home = row[use], anchor[use], home[use]
        order = np.argsort(anchor, kind="stable")
        row, anchor, home = row[order], anchor[order], home[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1, [len(anchor)]))
        some = np.concatenate(([0], np.cumsum(home)))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if hi - lo < 2 or some[hi] == some[lo]:
                continue
            g = x["fp"][row[lo:hi]]
            e = link_group(g, home[lo:hi], threshold)
            if e:
                yield [node(g[k], None) for k in np.array(e).T]

    return laid.mapInArrow(by_cell(solve), "u long, v long")


def by_cell(solve):
    """Gathers the rows (part, cell, salt, roles, data) of each cell, in order, for ``solve``; its edges as batches."""

    def run(batches):
        held: list[tuple[int, bytes]] = []
        last = None

        def flush():
            found = list(solve(last[0], last[1], held)) if held else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], ["u", "v"])

        for b in batches:
            for part, cell, salt, roles, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                if (part, cell, salt) != last:
                    yield from flush()
                    held, last = [], (part, cell, salt)
                held.append((roles, data))
        if held:
            yield from flush()

    return run


def sized_links(fps: DataFrame, threshold: int, both: int, ratio: float) -> DataFrame:
    """Edges u, v (see ``node``) that join all that are linked by two fingerprints and sizes (see ``link_ordered``).

    ``fps`` has fp, second and size. They are cut into slices in order of size
    (of a hash, where sizes agree), so that a slice has a bounded number; pairs
    of slices whose sizes allow a link are gone through by cells. Of a pair of
    fingerprints only the first in that order is looked for at home, so the
    lower slice of a pair sends each row to one cell of each part.
    """
    n = fps.count()
    starts, covers, _ = choose_cover(min(n, 2 * SLICE * CELL), threshold, COMPARE)
    place = F.col("size") + F.pmod(F.xxhash64("fp", "second"), F.lit(1 << 20)) / (1 << 20)
    fps = fps.select("fp", "second", "size", place.alias("place"))
    k = max(1, -(-n // (SLICE * CELL)))
    cuts = np.array(fps.agg(F.percentile_approx("place", [i / k for i in range(1, k)], F.lit(10_000 + 100 * k))).first()[0]) if k > 1 else np.zeros(0)
    low, high = np.floor([0.0, *cuts]), np.floor([*cuts, np.inf])
    pairs = [(s, t) for s in range(k) for t in range(s, k) if s == t or low[t] * ratio <= high[s]]
    # 1: homes, 2: others, 3: both
    goes = [[(s * k + t, 3 if s == t else 1 if s == own else 2) for s, t in pairs if own in (s, t)] for own in range(k)]
    copies = sum(1 / k if role == 1 else c.reach(1) / k for c in covers for some in goes for _, role in some)
    blocks = int(copies * _ITEM.itemsize <= TRAVEL)

    def dealt(batches):
        for b in batches:
            x = np.zeros(b.num_rows, _ITEM)
            x["fp"], x["second"], x["size"] = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
            own = np.searchsorted(cuts, b.column(3).to_numpy(), "right")
            out = []
            for part, (at, cover) in enumerate(zip(starts, covers)):
                row, prefix, used = cover.anchors(_part(x["fp"], at, cover), blocks)
                for cell in np.unique(prefix):
                    mine = prefix == cell
                    for s in np.unique(own[row[mine]]).tolist():
                        some = mine & (own[row] == s)
                        for salt, role in goes[s]:
                            data = x[row[some & (used == 0)] if role == 1 else row[some]]
                            if len(data):
                                out.append((part, int(cell), salt, role, data.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["part", "cell", "salt", "roles", "data"])

    spread = 3 * len(pairs) * sum(c.count(blocks) for c in covers)
    least = shuffle_count(fps.sparkSession)
    laid = fps.mapInArrow(dealt, "part int, cell long, salt int, roles int, data binary").repartition(max(least, min(spread, n // 64, 1 << 14)), "part", "cell", "salt").sortWithinPartitions("part", "cell", "salt")

    def solve(part: int, cell: int, held: list[tuple[int, bytes]]):
        x = np.concatenate([np.frombuffer(d, _ITEM) for _, d in held])
        roles = np.concatenate([np.full(len(d) // _ITEM.itemsize, r, np.int8) for r, d in held])
        order = np.argsort(x["size"], kind="stable")
        order = np.lexsort((roles, x["size"]))  # rows of the lower slice come first where sizes agree
        fp, second, size, roles = x["fp"][order], x["second"][order], x["size"][order], roles[order]
        del x, held[:]
        cover = covers[part]
        up = np.arange(len(fp), dtype=np.int32)
        for row, home in cover.groups(_part(fp, starts[part], cover), roles & 1 > 0, roles & 2 > 0, blocks, cell):
            e = link_ordered(row, fp[row], home, second[row], size[row].astype(float), threshold, both, ratio, up)
            if e:
                yield [node(fp[k], second[k]) for k in np.array(e).T]

    return laid.mapInArrow(by_cell(solve), "u long, v long")


def measured(docs: DataFrame, shingle: int) -> DataFrame:
    """key, doc_id, and of the distinct shingles two fingerprints, their node and the number, per row."""

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                h = np.unique(shingle_hashes(t, shingle))
                out.append((majority(h), majority(scatter(h)), len(h)))
            fp, second, size = (np.array([x[k] for x in out], np.uint64) for k in range(3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x) for x in (fp.view(np.int64), second.view(np.int64), node(fp, second), size.astype(np.int64))]], ["key", "doc_id", "fp", "second", "node", "size"])

    return docs.select(row_key("doc_id", "text").alias("key"), "doc_id", "text").mapInArrow(run, "key long, doc_id long, fp long, second long, node long, size long")


def similar(docs: DataFrame, wanted: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges u, v that join all nodes of a group whose texts are similar, if need be by others.

    ``wanted`` (node, root, key): groups of candidates, and the row whose text
    stands for each node. All pairs of a group are looked at: a group of more
    than 2048 texts or a million shingles is dealt to blocks, and each pair of
    blocks is a task's work of its own. Only similar pairs become edges, at
    most one for each text in a pair of blocks.
    """

    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.list_(pa.int64()))], ["node", "root", "s"])

    texts, _ = split_by_keys(docs.select(row_key("doc_id", "text").alias("key"), "text"), wanted, "key")
    texts = texts.join(wanted, "key").select("node", "root", "text")
    sets = materialize(texts.mapInArrow(run, "node long, root long, s array<long>").dropDuplicates(["node"]), "simhash-sets")
    many = sets.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / 2048, F.sum(F.size("s")) / (1 << 20))).cast("int").alias("blocks")).where("blocks > 1")
    dealt = sets.join(many, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "s")

    def solve(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        names, block, s = t["node"].to_numpy(), t["block"].to_numpy(), t["s"].combine_chunks()
        e = similar_pairs(s.flatten().to_numpy(), np.diff(s.offsets.to_numpy()), block if t["lo"][0] != t["hi"][0] else None, similarity)
        return pa.table({"u": names[[i for i, _ in e]], "v": names[[j for _, j in e]]})

    return cells.groupBy("root", "lo", "hi").applyInArrow(solve, "u long, v long")


def similar_pairs(flat: np.ndarray, sizes: np.ndarray, block: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Edges that join the sets (end to end in ``flat``) of that similarity; with ``block``, only pairs of different blocks count."""
    n = len(sizes)
    label, edges = np.arange(n), []
    _, ids = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)[np.argsort(ids, kind="stable")]
    holders = np.bincount(ids)
    first = np.cumsum(holders) - holders
    ends = np.cumsum(sizes)
    for i in range(n):
        open_ = label != label[i]
        open_ &= (np.arange(n) > i) if block is None else (block > block[i])
        open_ &= np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i])
        if not open_.any():
            continue
        mine = ids[ends[i] - sizes[i] : ends[i]]
        many = holders[mine]
        at = np.repeat(first[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        common = np.bincount(owner[at], minlength=n)
        close = np.flatnonzero(open_ & (common >= similarity * (sizes + sizes[i] - common)))
        roots, which = np.unique(label[close], return_index=True)
        for root, j in zip(roots.tolist(), close[which].tolist()):
            a, b = sorted((root, int(label[i])))
            label[label == b] = a
            edges.append((i, j))
    return edges


def shingles(text: str | None, shingle: int) -> set[int]:
    """Hashes (signed) of the distinct word shingles."""
    return set(shingle_hashes(text, shingle).view(np.int64).tolist())


def near_duplicates(docs: DataFrame, *, shingle: int = 4, threshold: int = 4) -> DataFrame:
    """Fingerprint and component of every row of ``docs`` (doc_id, text).

    Words are runs of non-white-space (ASCII), A-Z lower-cased; shingles are
    ``shingle`` words, repeats counted; fewer words make one shingle, none the
    fingerprint zero, which is linked like any other (null text: none).
    Fingerprints link at ``threshold`` or fewer differing bits, and
    component_id is the smallest doc_id that links reach, itself included;
    null doc_ids don't count unless a component has no other. Copies share a
    fingerprint and are not expanded into pairs. Repeated rows are kept, texts
    are read whole, other columns are not looked at. Empty input gives no rows.

    Returns doc_id, fingerprint (16 hex digits), component_id.
    """
    rows = materialize(fingerprints(docs, shingle), "simhash-fingerprints")
    own = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = materialize(components(links(own, threshold)).withColumnRenamed("node", "fp"), "simhash-components")
    rooted = own.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, shingle: int = 5, threshold: int = 14, both: int = 30, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs``, all columns, without all but one of each near-duplicate group.

    Texts link if the Jaccard similarity of their sets of word shingles is
    ``similarity`` or more. Candidates are what fingerprints within
    ``threshold`` bits join (within ``both`` bits of two fingerprints, and
    with numbers of shingles that allow the similarity), all with all. Texts
    at 0.8 differ in about 15 % of the bits, so 14 and 30 bits hold 19 of 20
    such pairs, and more of closer ones. Texts that agree in both
    fingerprints are linked as they are. The smallest doc_id of a group stays
    (a null one only if there is no other; among rows that share it the one
    with the least hash, once).

    Null and empty texts, and those without words, form a group. Repeated rows
    are copies. Columns may have any names. Empty input gives no rows.
    """
    rows = materialize(measured(docs, shingle), "simhash-measured")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key"))
    own = materialize(rows.groupBy("node").agg(best.alias("first"), F.count(F.lit(1)).alias("copies"), F.first("fp").alias("fp"), F.first("second").alias("second"), F.first("size").alias("size")), "simhash-distinct")
    groups = materialize(components(links(own, threshold, both, similarity)), "simhash-groups")
    wanted = materialize(groups.join(own.select("node", F.col("first.key").alias("key")), "node"), "simhash-wanted")
    linked = materialize(components(similar(docs, wanted, shingle, similarity)), "simhash-components")
    own = own.join(linked, "node", "left").select("node", "first", "copies", F.coalesce("root", "node").alias("root"))
    groups = own.groupBy("root").agg(F.min("first").alias("first"), F.sum("copies").alias("copies"))
    groups = materialize(groups.where("copies > 1"), "simhash-groups")
    touched = own.join(groups.select("root"), "root").select("node")
    touched = materialize(rows.join(touched, "node").select("key"), "simhash-touched")
    whole = docs.select(row_key("doc_id", "text").alias("key"), struct_of(docs.columns).alias("row"))
    maybe, alone = split_by_keys(whole, touched, "key")
    gone = touched.distinct().join(groups.select(F.col("first.key").alias("key")), "key", "left_anti")
    kept = maybe.join(materialize(gone, "simhash-gone"), "key", "left_anti").dropDuplicates(["key"])
    return alone.unionByName(kept).select("row.*")


def op8_simhash(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))
