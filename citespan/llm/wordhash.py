"""Hashes of a text's words, over arrays of code points: no string for each word is made."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
LETTER, DIGIT, UNDERSCORE, UPPER = 1, 2, 4, 8


class _Tables:
    """By code point: class bits, and the lower-case code point.  Planes 2 and 3 are letters, those above nothing."""

    made: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def get(cls) -> tuple[np.ndarray, np.ndarray]:
        if cls.made is None:
            n = 0x20000
            chars = [chr(i) for i in range(n)]
            kind = np.zeros(0x110000, np.uint8)
            kind[:n] = [(DIGIT if c.isdecimal() else LETTER if c.isalnum() else 0) | (UPPER if c.isupper() else 0) for c in chars]
            kind[0x5F], kind[0x20000:0x40000] = UNDERSCORE, LETTER
            low = np.arange(0x110000, dtype=np.uint32)
            low[:n] = [ord(c.lower()[0]) for c in chars]
            cls.made = kind, low
        return cls.made


class _Powers:
    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """P**i and P**-i for i < n, kept up to a million code points."""
        if n <= len(cls.up):
            return cls.up[:n], cls.down[:n]
        with np.errstate(over="ignore"):
            size = max(n, 1 << 16)
            up, down = np.full(size, _U(_P)), np.full(size, _U(_P_INVERSE))
            up[0] = down[0] = 1
            up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 1 << 20:
            cls.up, cls.down = up, down
        return up[:n], down[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classes(points: np.ndarray) -> np.ndarray:
    return _Tables.get()[0][points]


def run_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the lower-case code points of each run starts[i] ... ends[i] - 1."""
    up, down = _Powers.get(len(points))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((_Tables.get()[1][points].astype(np.uint64) + _U(1)) * up, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], on, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word of letters, digits and underscores, in either case the same."""
    points = code_points(text)
    if not len(points):
        return np.zeros(0, np.uint64)
    return run_hashes(points, *runs((classes(points) & (LETTER | DIGIT | UNDERSCORE)) > 0))
