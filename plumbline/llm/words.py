"""Hashes of the words of many texts at once, in numpy: no Python object is made for a word.

Words are runs of other bytes than ASCII white space; A-Z count as a-z. A word's hash is a polynomial over random numbers
for its bytes, taken from running sums (powers of an odd base have inverses modulo 2^64), and mixed.
"""

from __future__ import annotations

import re

import numpy as np

BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed together; a longer text is cut at white space.
PIECE = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NUMBERS = np.random.default_rng(31).integers(0, 2**64, 256, np.uint64)
_NUMBERS[65:91] = _NUMBERS[97:123]
_GAP = re.compile(rb"[\x09-\x0d\x20]")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """base^0, base^1, ... modulo 2^64, as far as asked."""

    def __init__(self, base: int) -> None:
        self.base, self.known = np.uint64(base % 2**64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            last = self.known[-1:] * self.base
            self.known = np.concatenate([self.known, self.known * last])
        return self.known[:n]


_UP, _DOWN = Powers(BASE), Powers(pow(BASE, -1, 2**64))


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run values[start:end]; equal runs have equal hashes wherever they stand."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _UP(len(values)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _DOWN(len(values) + 1)[starts] ^ (ends - starts).astype(np.uint64))


def _pieces(texts: list[bytes]) -> list[bytes]:
    """The texts, a line end after each, in pieces of about PIECE bytes that no word spans."""
    out: list[bytes] = []
    some: list[bytes] = []
    size = 0
    for t in texts:
        at = 0
        while len(t) - at > PIECE:
            gap = _GAP.search(t, at + PIECE)
            end = gap.end() if gap else len(t)
            out.append(b"\n".join([*some, t[at:end]]))
            some, size, at = [], 0, end
        some.append(t[at:])
        size += len(t) - at
        if size > PIECE:
            out.append(b"\n".join([*some, b""]))
            some, size = [], 0
    if some:
        out.append(b"\n".join([*some, b""]))
    return out


def line_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, one text after the other, and how many stand before the end of each line (one more line end
    is counted at the end of each text)."""
    hashes, ends, before = [], [], 0
    for piece in _pieces(texts):
        b = np.frombuffer(piece, np.uint8)
        space = _SPACE[b]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        hashes.append(runs(_NUMBERS[b], start, end))
        ends.append(np.searchsorted(start, np.flatnonzero(b == 10)) + before)
        before += len(start)
    none = np.zeros(0, np.int64)
    return np.concatenate(hashes or [none.view(np.uint64)]), np.concatenate(ends or [none])


def text_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words; how many words each text has; and line_words' second result."""
    h, ends = line_words(texts)
    lines = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    last = ends[np.cumsum(lines) - 1]
    return h, np.diff(last, prepend=0) if len(lines) else last, ends
