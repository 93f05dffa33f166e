"""Words of a text as numbers, in numpy: their places, lines and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import numpy as np

_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: A random number for each byte.
_BYTE = np.random.default_rng(2024).integers(1, 2**64, 256, np.uint64)
#: Bytes whose sums are taken together.
_PART = 1 << 18
_UP = np.concatenate([np.ones(1, np.uint64), np.full(_PART, _FACTOR)]).cumprod()
_DOWN = np.concatenate([np.ones(1, np.uint64), np.full(_PART, np.uint64(pow(int(_FACTOR), -1, 2**64)))]).cumprod()


def spread(x: np.ndarray) -> np.ndarray:
    """Mixes all bits of each number into all others."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words (runs outside of ASCII white space) begin and end."""
    edge = np.flatnonzero(np.diff(_GAP[raw], prepend=True, append=True))
    return edge[::2], edge[1::2]


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each word raw[start:end]: a polynomial in its bytes' numbers, as a difference of running sums."""
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        base = int(start[at])
        to = int(np.searchsorted(end, base + _PART, "right"))
        if to == at:  # a word longer than a part
            out[at] = _long(raw[base : end[at]])
            at += 1
            continue
        sums = np.zeros(end[to - 1] - base + 1, np.uint64)
        np.cumsum(_BYTE[raw[base : end[to - 1]]] * _UP[: len(sums) - 1], out=sums[1:])
        s, e = start[at:to] - base, end[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * _DOWN[s]
        at = to
    return spread(out + (end - start).astype(np.uint64) * _FACTOR)


def _long(raw: np.ndarray) -> np.uint64:
    parts = [np.sum(_BYTE[raw[k : k + _PART]] * _UP[: len(raw[k : k + _PART])], dtype=np.uint64) for k in range(0, len(raw), _PART)]
    total = np.zeros(1, np.uint64)
    for p in reversed(parts):
        total = total * _UP[_PART] + p
    return total[0]


def lines_at(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The line (from 1) that each place stands in."""
    return np.searchsorted(np.flatnonzero(raw == 10), start) + 1
