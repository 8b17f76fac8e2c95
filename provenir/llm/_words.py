"""Hashes of words and word shingles, for runs of texts at a time."""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C55
_P_INVERSE = pow(_P, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Space and the control characters from tab to carriage return.
BLANKS = [32, *range(9, 14)]
#: All of ASCII but letters and digits.
MARKS = [c for c in range(128) if not chr(c).isalnum()]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below n."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def word_hashes(texts: list[str], separators: list[int] = BLANKS, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and where each text's words begin (one entry more than texts).

    Words are runs of bytes of UTF-8 that are no separator, with A-Z lower-cased; fold lower-cases all letters.
    """
    coded = [(t.lower().encode() if fold else t.encode().lower()) for t in texts]
    sizes = np.cumsum([0, *(len(c) + 1 for c in coded)])
    buf = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
    value = np.arange(1, 257, dtype=np.uint64)
    value[separators] = 0
    v = value[buf]
    inside = v != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]  # the last byte is a separator, so every word ends
    power, inverse = _powers(len(buf))
    v *= power
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    return hashes, np.searchsorted(starts, sizes)


def spaced(hashes: np.ndarray, offsets: list[int], salt: int = 0) -> np.ndarray:
    """For every place from which all offsets exist: a hash of the words at place + offset, in order."""
    n = len(hashes) - max(offsets)
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    factor = 1
    for k in offsets:
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        out += hashes[k : k + n] * np.uint64(factor)
    return mix(out)
