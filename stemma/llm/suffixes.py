"""A suffix array over all texts of a collection, in parts: suffixes that begin alike meet in one cell.

Texts are dealt into blocks by a hash. Of each block all suffixes are sorted by their first letters, as
many as fit the words of a key, and cut into cells by fewer leading letters than a span of interest
has: all suffixes with such a span in common fall into one cell, whatever their blocks. A cell
merges the sorted runs of all blocks into its piece of the suffix array and reads off neighbours.
Equal keys of a block are one entry, so that a text repeated by a third of all rows, or a
phrase found everywhere, makes no entry larger.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Letters of a shared span at least, and letters of a suffix that are sorted. A longer span shows in the suffixes that begin inside it.
K, DEPTH = 5, 12
_BITS = 60


class Alphabet:
    """The letters of a collection, numbered from 1 in code-point order; 0 is the end of a text."""

    def __init__(self, points: np.ndarray):
        self.points = np.unique(points)
        self.bits = max(1, int(len(self.points)).bit_length())
        self.per_word = _BITS // self.bits
        self.words = -(-DEPTH // self.per_word)

    def cell_letters(self, total: int, each: int = 100_000) -> int:
        """Leading letters that make cells of about ``each`` suffixes, ``K`` at most."""
        n = 1
        while n < min(K, self.per_word) and len(self.points) ** n * each < total:
            n += 1
        return n


def shared_letters(a: np.ndarray, b: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    """Length of the common prefix of the keys ``a[i]`` and ``b[i]`` (one column a word), up to ``DEPTH``; the end of a text is no letter."""
    out, open_ = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for w in range(alphabet.words):
        d = a[:, w] ^ b[:, w]
        top = np.zeros(len(d), np.int64)
        high = (d >> np.uint64(32)).astype(np.float64)
        low = (d & np.uint64(0xFFFFFFFF)).astype(np.float64)
        top = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])  # bits up to the highest that differs
        same = np.where(d == 0, alphabet.per_word, alphabet.per_word - -(-top // alphabet.bits))
        out += np.where(open_, same, 0)
        open_ &= d == 0
    return np.minimum(np.minimum(out, lengths_of(a, alphabet)), DEPTH)


def lengths_of(keys: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    """Letters of a key before the end of its text."""
    n = np.zeros(len(keys), np.int64)
    mask = np.uint64((1 << alphabet.bits) - 1)
    for i in range(K, DEPTH):
        w, j = divmod(i, alphabet.per_word)
        n += (keys[:, w] >> np.uint64(alphabet.bits * (alphabet.per_word - 1 - j)) & mask) > 0
    return n + K


class Block:
    """The sorted suffixes of some texts: those with ``K`` letters at least."""

    def __init__(self, texts: list[str], alphabet: Alphabet):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.row = np.repeat(np.arange(len(texts)), size)
        at = np.arange(len(raw)) + self.row * DEPTH  # each text is followed by ends, so that no key reads on into the next
        codes = np.zeros(len(raw) + len(texts) * DEPTH + DEPTH, np.uint64)
        codes[at] = np.searchsorted(alphabet.points, raw).astype(np.uint64) + np.uint64(1)
        ends = np.cumsum(size)
        self.pos = np.flatnonzero(np.arange(len(raw)) + K <= ends[self.row]) if len(raw) else np.zeros(0, np.int64)
        self.size = size
        spots = at[self.pos]
        keys = np.zeros((len(spots), alphabet.words), np.uint64)
        for i in range(alphabet.words * alphabet.per_word):
            w = i // alphabet.per_word
            keys[:, w] <<= np.uint64(alphabet.bits)
            if i < DEPTH:
                keys[:, w] |= codes[spots + i]
        order = np.lexsort(keys.T[::-1]) if alphabet.words > 1 else np.argsort(keys[:, 0], kind="stable")
        self.pos, keys = self.pos[order], keys[order]
        new = np.r_[True, (keys[1:] != keys[:-1]).any(1)] if len(keys) else np.zeros(0, bool)
        self.entry = np.cumsum(new) - 1  # of each suffix its entry
        self.keys = keys[new]
        first = np.r_[True, shared_letters(self.keys[1:], self.keys[:-1], alphabet) < K] if len(self.keys) else np.zeros(0, bool)
        self.shingle_start = np.flatnonzero(first)
        self.shingle = np.cumsum(first) - 1  # of each entry its shingle, a span of K letters

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and shingle of each distinct shingle of each text, ordered by text."""
        n = max(1, len(self.shingle_start))
        both = np.unique(self.row[self.pos] * n + self.shingle[self.entry]) if len(self.pos) else np.zeros(0, np.int64)
        return both // n, both % n

    def codes(self, alphabet: Alphabet) -> np.ndarray:
        """A number of each shingle that is the same in all blocks: its letters where they fit a word, else a hash of them."""
        keys = self.keys[self.shingle_start]
        if alphabet.per_word >= K:
            return keys[:, 0] >> np.uint64(alphabet.bits * (alphabet.per_word - K))
        out = np.zeros(len(keys), np.uint64)
        mask = np.uint64((1 << alphabet.bits) - 1)
        for i in range(K):
            w, j = divmod(i, alphabet.per_word)
            out = (out ^ (keys[:, w] >> np.uint64(alphabet.bits * (alphabet.per_word - 1 - j)) & mask)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out


def planes(a: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes, then all second bytes: small numbers compress well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplaned(raw: bytes, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).reshape(-1).view(kind)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any lengths as one compressed value."""
    head = np.array([len(a) for a in arrays], np.uint32).tobytes()
    return zlib.compress(head + b"".join(planes(a) if len(a) else b"" for a in arrays), 1)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zlib.decompress(blob)
    sizes, at, out = np.frombuffer(raw, np.uint32, len(kinds)).tolist(), 4 * len(kinds), []
    for kind, n in zip(kinds, sizes):
        size = np.dtype(kind).itemsize * n
        out.append(unplaned(raw[at : at + size], kind, n))
        at += size
    return out


def pack_keys(keys: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted keys, the first word as steps, with further arrays."""
    step = np.diff(keys[:, 0], prepend=np.uint64(0))
    return pack(step, *(np.ascontiguousarray(keys[:, w]) for w in range(1, keys.shape[1])), *more)


def unpack_keys(blob: bytes, words: int, *kinds) -> tuple[np.ndarray, list[np.ndarray]]:
    got = unpack(blob, *[np.uint64] * words, *kinds)
    return np.stack([np.cumsum(got[0], dtype=np.uint64), *got[1:words]], 1), got[words:]


def cross_neighbours(keys: np.ndarray, sides: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    """Of each entry of a suffix array, for both sides, the longest prefix that it shares with a suffix of the other side.

    ``sides`` has bit 0 and bit 1. In sorted order the longest common prefix with any suffix of the other side is that
    with the nearest one above or below. Entry (i, s) is 0 where the entry isn't of side s or no prefix of ``K`` letters is shared.
    """
    n = len(keys)
    out = np.zeros((n, 2), np.uint8)
    at = np.arange(n)
    for s in (0, 1):
        own, other = np.flatnonzero(sides >> s & 1), (sides >> (1 - s) & 1).astype(bool)
        above = np.maximum.accumulate(np.where(other, at, -1))[own]
        below = np.minimum.accumulate(np.where(other, at, n)[::-1])[::-1][own]
        best = np.zeros(len(own), np.int64)
        for near, ok in ((above, above >= 0), (below, below < n)):
            best[ok] = np.maximum(best[ok], shared_letters(keys[own[ok]], keys[near[ok]], alphabet))
        out[own, s] = np.where(best >= K, best, 0)
    return out


def covered(block: Block, texts: int, spans: np.ndarray) -> np.ndarray:
    """Letters of each text in the union of spans: of each suffix as many letters from its start as ``spans`` says."""
    total = int(block.size.sum())
    step = np.zeros(total + 1, np.int64)
    some = spans > 0
    np.add.at(step, block.pos[some], 1)
    np.add.at(step, block.pos[some] + spans[some], -1)
    return np.bincount(block.row[np.cumsum(step)[:total] > 0], minlength=texts)
