"""Substrings that occur elsewhere, by suffix arrays of linear grouping."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import documents
from .windows import Windows, byte_grams, runs, with_spans

#: Bytes in a symbol of the suffix arrays. Contexts of an anchor are cut into
#: symbols at the same places relative to the anchor, so equal windows are cut
#: alike and any of them holds a run of whole symbols.
BLOCK = 16


def suffix_array(seq: list[int]) -> list[int]:
    """Suffix array of ``seq`` by grouping, without recursive renaming.

    First, suffixes lie in groups by their first symbol. Groups are taken in
    descending order. Each suffix of a group points to the nearest suffix to
    its left in a lower group (its previous smaller one); suffixes with k
    pointers from the group move to a group of their own right above their old
    one, the higher the larger k. In the end a group holds the suffixes with
    the same Lyndon prefix. Second, in ascending order, every suffix put in
    place puts its left neighbour, then that one's previous smaller ones, at
    the next places of their groups.
    """
    n = len(seq)
    if not n:
        return []
    by: dict[int, list[int]] = {}
    for i, c in enumerate(seq):
        by.setdefault(c, []).append(i)
    members = [by[c] for c in sorted(by)]
    group = [0] * n
    for g, some in enumerate(members):
        for i in some:
            group[i] = g
    lower = list(range(-1, len(members) - 1))
    upper = [*range(1, len(members)), -1]
    smaller, jump, done = [-1] * n, [-1] * n, bytearray(n)
    g = len(members) - 1
    while g != -1:
        some = sorted(i for i in members[g] if group[i] == g)
        for i in some:
            done[i] = 1
        pointers: dict[int, int] = {}
        for i in some:
            p = i - 1
            while p >= 0 and done[p]:
                q = jump[p]
                if q >= 0 and done[q]:
                    q = jump[p] = jump[q]
                p = q
            smaller[i] = jump[i] = p
            if p >= 0:
                pointers[p] = pointers.get(p, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for p, k in pointers.items():
            moves.setdefault((k, group[p]), []).append(p)
        for k, old in sorted(moves, reverse=True):
            new, above = len(members), upper[old]
            members.append(moves[k, old])
            for p in moves[k, old]:
                group[p] = new
            lower.append(old)
            upper.append(above)
            upper[old] = new
            if above != -1:
                lower[above] = new
        g = lower[g]
    sizes = [0] * len(members)
    for x in group:
        sizes[x] += 1
    slot, at = [0] * len(members), 0
    g = 0
    while lower[g] != -1:
        g = lower[g]
    while g != -1:
        slot[g] = at
        at += sizes[g]
        g = upper[g]
    order, placed = [0] * n, bytearray(n)

    def put(p: int) -> None:
        while p >= 0 and not placed[p]:
            placed[p] = 1
            order[slot[group[p]]] = p
            slot[group[p]] += 1
            p = smaller[p]

    put(n - 1)
    for i in range(n):
        put(order[i] - 1)
    return order


def solve(contexts: list[tuple], length: int) -> list[list[tuple[int, int]]]:
    """Spans of each context covered by windows that start in it and elsewhere.

    One suffix array over the contexts' symbols brings together suffixes that
    share as many symbols as a window must hold; the windows around these are
    then told apart by their bytes.
    """
    seq: list[int] = []
    where: list[tuple[int, int]] = []  # context and byte of each symbol
    ids: dict[bytes, int] = {}
    for c, (_, _, data, _, at) in enumerate(contexts):
        for o in range(at % BLOCK, len(data) - BLOCK + 1, BLOCK):
            seq.append(ids.setdefault(data[o : o + BLOCK], len(ids)))
            where.append((c, o))
        seq.append(-1 - c)
        where.append((c, -1))
    least = (length - BLOCK + 1) // BLOCK
    order = suffix_array(seq)
    flags = [np.zeros(windows, np.int8) for _, _, _, windows, _ in contexts]

    def settle(cluster: list[int]) -> None:
        for e in range(BLOCK):
            seen: dict[bytes, tuple[int, int] | None] = {}
            for i in cluster:
                c, o = where[i]
                p = o - e
                if p < 0 or p >= len(flags[c]):
                    continue
                w = contexts[c][2][p : p + length]
                if w not in seen:
                    seen[w] = (c, p)
                    continue
                flags[c][p] = 1
                if (first := seen[w]) is not None:
                    flags[first[0]][first[1]] = 1
                    seen[w] = None

    cluster: list[int] = []
    for i in order:
        if cluster and seq[i : i + least] != seq[cluster[-1] : cluster[-1] + least]:
            if len(cluster) > 1:
                settle(cluster)
            cluster = []
        cluster.append(i)
    if len(cluster) > 1:
        settle(cluster)
    return [runs(f, length) for f in flags]


def _windows(length: int) -> Windows:
    if length < 64:
        raise ValueError("length must be at least 64 bytes")
    return Windows(length, 32, False, lambda text: np.frombuffer(text.encode(), np.uint8), byte_grams, lambda some: solve(some, length))


def _cut(text: str | None, spans: list[tuple[int, int]]):
    data = (text or "").encode()
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    left = b"".join([*kept, data[at:]])
    plain = text if not spans else left.decode(errors="ignore")
    return len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), plain


def remove_repeats(docs: DataFrame, *, length: int = 200, keep: tuple[str, ...] = ("doc_id",), cap: int | None = None) -> DataFrame:
    """Cut every byte covered by a ``length``-byte string that also starts elsewhere.

    Texts are UTF-8 bytes; matches stay within a document; all copies of a
    string go, within one document too, and overlaps count. ``docs`` needs
    doc_id and text; columns in ``keep`` are carried through.

    Nulls: a null text is empty for the counts and stays null; a null doc_id
    is a document like any other. Repeated rows are copies of each other.
    Shorter texts are returned as they are. Empty input gives no rows.

    Returns ``keep``, n_bytes, n_removed, n_spans, kept_sha256, kept_text (what
    is left, without parts of characters that a cut has split).
    """
    spans = _windows(length).repeats(docs, **({} if cap is None else {"cap": cap}))
    return with_spans(docs, spans, list(keep), "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string", _cut)


def op2_suffix(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir)).drop("kept_text")


ORACLE = r"""
WITH w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM w WHERE len(x) >= 400),
k AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM p),
m AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
r AS (SELECT k.doc_id, k.i, lag(k.i) OVER (PARTITION BY k.doc_id ORDER BY k.i) AS before FROM k SEMI JOIN m ON k.h = m.h),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM r),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY 1, 2),
t AS (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM s),
kept AS (SELECT t.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(w.x, CAST(2 * coalesce(prev, 0) + 1 AS BIGINT), CAST(2 * (a - coalesce(prev, 0)) AS BIGINT)), '' ORDER BY a) AS head FROM t JOIN w ON t.doc_id = w.doc_id GROUP BY 1)
SELECT w.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE head || substr(x, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
