"""Texts of an Arrow batch as flat arrays of code points, and rolling hashes over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def blocks(lengths: np.ndarray, most: int = 1_000_000, rows: int = 60_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` characters; a longer text is a range of its own, never cut."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (total + n > most or i - start >= rows):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in a row, the row of each, and the end of each row."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.repeat(np.arange(len(texts)), lengths), np.cumsum(lengths)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x ^= x >> np.uint64(29)
    x *= _A
    return x ^ (x >> np.uint64(32))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * _A
    out ^= out >> np.uint64(31)
    out += b
    out *= _B
    return out ^ (out >> np.uint64(29))


def rolling(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` code points from each position, by doubling of lengths."""
    if len(points) < k:
        return np.zeros(0, np.uint64)
    power, length, out, done = mix(points.astype(np.uint64) + np.uint64(1)), 1, None, 0
    while True:
        if k & length:
            if out is None:
                out, done = power, length
            else:
                m = len(points) - done - length + 1
                out, done = _join(out[:m], power[done : done + m]), done + length
        if done == k:
            return out
        m = len(power) - length
        power, length = _join(power[:m], power[length : length + m]), length * 2


def inside(row: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """True at the positions whose ``k`` code points lie in one text."""
    m = max(0, len(row) - k + 1)
    return np.arange(k, k + m) <= ends[row[:m]]


def product(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of the ranges a x b, range by range."""
    na, nb = a1 - a0, b1 - b0
    n = na * nb
    start = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(start, n)
    nb = np.repeat(nb, n)
    return np.repeat(a0, n) + at // nb, np.repeat(b0, n) + at % nb


def triangle(a0: np.ndarray, a1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs i < j within each of the ranges."""
    i, j = product(a0, a1, a0, a1)
    return i[i < j], j[i < j]
