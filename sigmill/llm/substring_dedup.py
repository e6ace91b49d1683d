"""Passages of words that an earlier document holds, by suffix automata."""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .common import documents
from .windows import Windows, merge, symbol_grams, with_spans


class Automaton:
    """Suffix automaton of several sequences: a state per class of substrings."""

    def __init__(self):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, seq: list[int]) -> None:
        step, link, length = self.step, self.link, self.length
        last = 0
        for c in seq:
            if (q := step[last].get(c)) is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._split(last, c, q)
                continue
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p != -1:
                q = step[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new

    def _split(self, p: int, c: int, q: int) -> int:
        twin = len(self.step)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = twin
        while p != -1 and self.step[p].get(c) == q:
            self.step[p][c] = twin
            p = self.link[p]
        return twin

    def statistics(self, seq: list[int]) -> list[int]:
        """For each place, the longest match that ends there."""
        out, state, n = [], 0, 0
        step, link, length = self.step, self.link, self.length
        for c in seq:
            while state and c not in step[state]:
                state = link[state]
                n = length[state]
            if c in step[state]:
                state = step[state][c]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def solve(contexts: list[tuple], length: int) -> list[list[tuple[int, int]]]:
    """Spans of each context with ``length`` or more words of a smaller doc_id's contexts.

    An anchor's contexts are one shard. Its documents stream past in order of
    doc_id: each is measured against the automaton of those before it, then
    added to it.
    """
    out: list[list[tuple[int, int]]] = []
    for _, shard in groupby(contexts, key=lambda x: x[0]):
        documents_ = [list(some) for _, some in groupby(shard, key=lambda x: x[1])]
        automaton = Automaton()
        for k, some in enumerate(documents_):
            seqs = [np.frombuffer(x[2], np.uint64).tolist() for x in some]
            for seq in seqs:
                spans = []
                if k:
                    spans = merge((i + 1 - n, i + 1) for i, n in enumerate(automaton.statistics(seq)) if n >= length)
                out.append(spans)
            if k + 1 < len(documents_):
                for seq in seqs:
                    automaton.add(seq)
    return out


def _symbols(text: str) -> np.ndarray:
    words = text.encode().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _windows(words: int) -> Windows:
    if words < 16:
        raise ValueError("windows must have at least 16 words")
    return Windows(words, 8, True, _symbols, symbol_grams, lambda some: solve(some, words))


def _cut(text: str | None, spans: list[tuple[int, int]]):
    words = (text or "").encode().split()
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    left = b" ".join(kept)
    return len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode() if spans else text


def remove_passages(docs: DataFrame, *, words: int = 50, keep: tuple[str, ...] = ("doc_id",), cap: int | None = None) -> DataFrame:
    """Cut every word covered by a window of ``words`` words that starts in a smaller doc_id too.

    Words are runs of non-white-space (ASCII), unchanged. ``docs`` needs doc_id
    and text; columns in ``keep`` are carried through.

    Nulls: a null text has no words and stays null; a document with a null
    doc_id has no place in the order: nothing is cut from it or for it. Rows
    with equal doc_id are not before one another. Shorter texts are returned
    as they are. Empty input gives no rows.

    Returns ``keep``, n_words, n_removed, kept_sha256 (kept words joined by
    spaces), kept_text (the same where words were cut, else the text).
    """
    spans = _windows(words).repeats(docs, **({} if cap is None else {"cap": cap}))
    return with_spans(docs, spans, list(keep), "n_words long, n_removed long, kept_sha256 string, kept_text string", _cut)


def op6_substring(spark, sf_dir):
    return remove_passages(documents(spark, sf_dir)).drop("kept_text")


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50 AND doc_id IS NOT NULL),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS least FROM k GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT k.doc_id, k.i FROM k JOIN m ON k.h = m.h WHERE k.doc_id > m.least),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM r),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w WHERE doc_id IN (SELECT doc_id FROM c)),
t AS (SELECT e.doc_id, count(*) AS n_words, count(c.j) AS n_removed, coalesce(string_agg(CASE WHEN c.j IS NULL THEN e.word END, ' ' ORDER BY e.j), '') AS kept FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.j = c.j GROUP BY 1)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t.kept, array_to_string(w.ws, ' '))) AS kept_sha256
FROM w LEFT JOIN t ON w.doc_id = t.doc_id
"""
