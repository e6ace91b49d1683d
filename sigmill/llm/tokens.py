"""Token ids of whole texts with a bounded memo of text pieces.

A text falls apart at places where no token can reach across, so a piece that
came before is looked up instead of being encoded again. New pieces are
encoded by ``tokenizers``: plain ones go straight to its model, all others
through its whole chain. Ids are those of ``tokenizers`` on the whole text.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import regex

#: Runs of white space that reach across pieces; such texts are encoded as a whole.
_BLANKS = re.compile(r"\s\s(?:\s|\Z)")
#: Marks a piece without a space before it (a text that holds it is encoded as a whole).
_BARE = "\x01"
#: Pieces with other characters are left to the library's own splitting.
_PLAIN = re.compile("[\\x20-\\x7e\\n\\xa1-\\xac\\xae-ɏ]*").fullmatch
#: The splitting rule that byte-level vocabularies use where their file names none.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[int, str]:
    """How byte-level models write bytes: printable ones as themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_STOPS = frozenset(".,")


class _Memo(dict):
    """Number of each piece; a new one is noted and numbered, and kept unless it is long."""

    def __init__(self):
        self.new: list = []
        self.count = 0

    def __missing__(self, piece):
        n, self.count = self.count, self.count + 1
        self.new.append(piece)
        if len(piece) <= 64:
            self[piece] = n
        return n


class Encoder:
    """``spaces``: the vocabulary keeps spaces (byte-level) or drops them and case."""

    def __init__(self, path: str, spaces: bool, most: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.spaces, self.most = Tokenizer.from_file(path), spaces, most
        plan = json.loads(self.model.to_str())["pre_tokenizer"]
        named = [x["pattern"]["Regex"] for x in plan.get("pretokenizers", []) if "pattern" in x]
        self.split = regex.compile(named[0] if named else _BYTE_LEVEL).findall
        self.bpe, self.alphabet = self.model.model, _byte_alphabet()
        self._forget()

    def _forget(self) -> None:
        self.place, self.part = _Memo(), {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _pieces(self, text: str) -> list:
        if not self.spaces:
            return text.encode().lower().split()  # at ASCII white space only; case is dropped anyway
        if "<|" in text or _BARE in text or _BLANKS.search(text):
            return [_BARE + text]
        return (_BARE + text.replace("\n", f" \n {_BARE}")).split(" ")

    def _whole(self, piece: str) -> list[int]:
        return self.model.encode(piece, add_special_tokens=False).ids

    def _encode(self, piece) -> list[int]:
        if not self.spaces:
            text = piece.decode()
        elif piece[:1] == _BARE:
            text = piece[1:]
        else:
            text = piece if piece == "\n" else " " + piece
        if not text:
            return []
        stop = text[-1] if text[-1] in _STOPS else ""
        word = text[: len(text) - len(stop)]
        letters = word[1:] if self.spaces and word[:1] == " " else word
        if letters.isalpha() and _PLAIN(letters) and (self.spaces or letters == letters.lower()):
            return self._part(word) + (self._stop(stop) if stop else [])
        if "<|" in text or not _PLAIN(text):
            return self._whole(text)
        if not self.spaces and text.lower() != text:
            text = text.lower()
        parts = self.split(text)
        if len(parts) == 1 and len(parts[0]) == len(text):
            return self._part(text)
        out: list[int] = []
        for p in parts:
            got = self.part.get(p)
            if got is None:
                got = self._part(p)
                if len(p) < 4:
                    self.part[p] = got
            out += got
        return out

    def _stop(self, text: str) -> list[int]:
        if text not in self.part:
            self.part[text] = self._part(text)
        return self.part[text]

    def _part(self, text: str) -> list[int]:
        shown = text.encode().decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.bpe.tokenize(shown)]

    def _encode_all(self, new: list) -> list[list[int]]:
        """Ids of pieces; words of ASCII letters, with or without a stop, need no splitting and no byte mapping."""
        bpe, lead = self.bpe.tokenize, self.alphabet[32] if self.spaces else ""
        stops = {mark: self._stop(mark) for mark in _STOPS}
        out = []
        for piece in new:
            word, stop = piece, None
            if not piece.isalpha():
                last = piece[-1:] if self.spaces else piece[-1:].decode("latin-1")
                if (stop := stops.get(last)) is not None:
                    word = piece[:-1]
            if word.isalpha() and word.isascii():
                ids = [t.id for t in bpe(lead + (word if self.spaces else word.decode()))]
                out.append(ids + stop if stop else ids)
            else:
                out.append(self._encode(piece))
        return out

    def _learn(self) -> None:
        new, self.place.new = self.place.new, []
        if not new:
            return
        got = self._encode_all(new)
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(lengths.sum()))
        n = self.place.count - len(new)
        while self.place.count > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.start[n : n + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(new)] = lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (uint32) of every text; None counts as empty."""
        if self.place.count > self.most:
            self._forget()
        look = self.place.__getitem__
        places: list[int] = []
        ends = []
        for t in texts:
            if t:
                places += map(look, self._pieces(t))
            ends.append(len(places))
        self._learn()
        at = np.array(places, np.int64)
        length = self.length[at]
        upto = np.concatenate(([0], np.cumsum(length)))
        flat = self.ids[np.repeat(self.start[at] - upto[:-1], length) + np.arange(upto[-1])]
        cuts = upto[np.array(ends, np.int64)].tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts)]
