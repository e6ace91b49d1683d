"""Plain versions of the operators, for small inputs."""

import hashlib
from collections import Counter, defaultdict

import xxhash

SPACE = b" \t\n\r\x0b\x0c"


def words(text):
    return (text or "").encode().split()


def suffix_dedup(rows, length):
    """rows: (doc_id, text) -> {index: (n_bytes, n_removed, n_spans, sha)}"""
    seen = Counter()
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        for p in range(len(d) - length + 1):
            seen[d[p : p + length]] += 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        left = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out


def substring_dedup(rows, size):
    first = {}
    ws = [words(t) for _, t in rows]
    for (k, _), w in zip(rows, ws):
        if k is not None:
            for p in range(len(w) - size + 1):
                x = tuple(w[p : p + size])
                first[x] = min(first.get(x, k), k)
    out = []
    for (k, _), w in zip(rows, ws):
        gone = bytearray(len(w))
        for p in range(len(w) - size + 1):
            if k is not None and first[tuple(w[p : p + size])] < k:
                gone[p : p + size] = b"\1" * size
        left = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out


def fingerprint(text, shingle=4):
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    sh = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_duplicates(rows, threshold=4):
    fp = [fingerprint(t) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= threshold:
                a, b = part[i], part[j]
                part = [min(a, b) if x in (a, b) else x for x in part]
    least = {}
    for (k, _), p in zip(rows, part):
        if k is not None:
            least[p] = min(k, least.get(p, k))
    return [(f"{f:016x}", least.get(p)) for f, p in zip(fp, part)]


def repeat_words(w, size=3):
    """Words in windows of ``size`` words found twice or more."""
    at = defaultdict(list)
    for i in range(len(w) - size + 1):
        at[tuple(w[i : i + size])].append(i)
    gone = set()
    for p in at.values():
        if len(p) > 1:
            gone.update(i + k for i in p for k in range(size))
    return len(gone)
