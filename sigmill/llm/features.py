"""Measures of a text for classifiers, in one pass over its bytes and words."""

from __future__ import annotations

from collections import Counter

import numpy as np

_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_UPPER, _DIGIT, _SYMBOL = (np.array([b in some for b in range(256)]) for some in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>"))
_LOWER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])

NAMES = ["words", "upper", "digits", "symbols", "exclaim", "bars", "word_length", "same_next", "distinct", "top_word", "dup_lines", "periods", "odd_ends"]


def tokens(text: str | None) -> list[bytes]:
    """Runs of letters (all but ASCII counts as one), lower-cased."""
    return (text or "").lower().encode().translate(_LETTERS).split()


def dense(text: str | None) -> list[float]:
    """The measures named in NAMES; all 0 for a text without words."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = max(1, int(hist[_UPPER].sum() + hist[_LOWER].sum()))
    size = max(1, len(data) - n)
    count = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)),
        float(hist[_UPPER].sum()) / letters,
        float(hist[_DIGIT].sum()) / size,
        float(hist[_SYMBOL].sum()) / size,
        float(hist[33]) / n,
        float(hist[124]) / n,
        min(30.0, size / n),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        len(count) / n,
        max(count.values()) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        float(hist[46]) / n,
        sum(w[-1] in b"#*$%&|<>" for w in words) / n,
    ]


class Scale:
    """Centre and spread of dense measures; values are cut off at five spreads."""

    def __init__(self, x: np.ndarray):
        self.mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        self.spread = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(x.shape[1])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -5, 5)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
