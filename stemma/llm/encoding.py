"""The whole corpus as token ids of a public byte-level BPE vocabulary, by corpus-level merge replay."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks

#: The pattern that splits text before the merges (fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a task keeps between blocks.
KEPT = 400_000
#: Ranks up to this are applied with arrays, since many positions have them; later ones singly.
DENSE = 1024


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes, a blank, its id, a line each."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The pair of ids that each token of several bytes is merged from, with the token's id."""
    out = {}
    for token, rank in ranks.items():
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: r if (r := ranks.get(parts[i] + parts[i + 1])) is not None and r < rank else 1 << 40)
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2 and parts[0] in ranks and parts[1] in ranks:
            out[ranks[parts[0]], ranks[parts[1]]] = rank
    return out


class Replay:
    """Token ids of many words at once.

    All words lie in one row of symbols, linked forwards and backwards, with a stop between
    them. An inverted index holds for every mergeable pair the positions where it stands.
    Merges are applied in rank order, each to all its positions in all words; only the
    pairs with the left and right neighbour of a merged symbol enter the index anew, and
    their ranks are always higher. A position whose pair has changed since is passed over.
    """

    def __init__(self, ranks: dict[bytes, int], merges: dict[tuple[int, int], int]):
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pair = {a << 32 | b: r for (a, b), r in merges.items()}
        keys = np.array(sorted(self.pair), np.int64)
        self.keys, self.rank = keys, np.array([self.pair[k] for k in keys.tolist()], np.int64)
        self.parts = {r: (a, b) for (a, b), r in merges.items()}
        self.order = sorted(self.parts)
        self.kind = np.uint16 if max(ranks.values()) < 65536 else np.uint32

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = np.where((a >= 0) & (b >= 0), a << 32 | b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], -1)

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Of each word its ids, packed as numbers of the kind ``self.kind``."""
        if not words:
            return []
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        tok = np.r_[-1, self.byte[raw]]  # position 0 and each word's end are stops
        tok[ends + 1] = -1
        nxt, prv = np.arange(1, len(tok) + 1), np.arange(-1, len(tok) - 1)
        nxt[-1], prv[0] = len(tok) - 1, 0
        index: dict[int, list[np.ndarray]] = {}

        def enter(at: np.ndarray, rank: np.ndarray) -> None:
            ok = rank >= 0
            at, rank = at[ok], rank[ok]
            if len(at):
                by = np.argsort(rank, kind="stable")
                at, rank = at[by], rank[by]
                edge = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
                for r, part in zip(rank[edge].tolist(), np.split(at, edge[1:])):
                    index.setdefault(r, []).append(part)

        enter(np.arange(len(tok) - 1), self._ranks(tok[:-1], tok[1:]))
        for r in self.order[:DENSE]:
            if r not in index:
                continue
            a, b = self.parts[r]
            at = np.unique(np.concatenate(index.pop(r)))
            at = at[(tok[at] == a) & (tok[nxt[at]] == b)]
            if a == b and len(at) > 1:  # of overlapping pairs every second one, from the left
                run = np.r_[True, nxt[at[:-1]] != at[1:]]
                first = np.flatnonzero(run)
                at = at[(np.arange(len(at)) - first[np.cumsum(run) - 1]) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            tok[at], tok[gone] = r, -2
            nxt[at] = nxt[gone]
            prv[nxt[at]] = at
            left = prv[at]
            enter(left, self._ranks(tok[left], tok[at]))
            enter(at, self._ranks(tok[at], tok[nxt[at]]))
        alive = tok != -2
        new = np.cumsum(alive) - 1
        for r in index:
            index[r] = [new[p[alive[p]]] for p in index[r]]
        t, pair = tok[alive].tolist(), self.pair.get
        n = list(range(1, len(t) + 1))
        n[-1] = len(t) - 1
        p = list(range(-1, len(t) - 1))
        p[0] = 0
        todo = {r: np.concatenate(x).tolist() for r, x in index.items()}
        for r in self.order[DENSE:]:
            at = todo.pop(r, None)
            if at is None:
                continue
            at.sort()
            a, b = self.parts[r]
            for i in at:
                j = n[i]
                if t[i] != a or t[j] != b:
                    continue
                k = n[j]
                t[i], t[j], n[i], p[k] = r, -2, k, i
                c = t[k]
                if c >= 0:
                    x = pair(r << 32 | c)
                    if x is not None:
                        todo.setdefault(x, []).append(i)
                h = p[i]
                c = t[h]
                if c >= 0:
                    x = pair(c << 32 | r)
                    if x is not None:
                        todo.setdefault(x, []).append(h)
        out = np.array(t, np.int64)
        out = out[out != -2][1:]
        stop = np.flatnonzero(out == -1)
        ids = out.astype(self.kind).tobytes()
        size = np.dtype(self.kind).itemsize
        starts = np.r_[0, stop[:-1] + 1]
        return [ids[a * size : b * size] for a, b in zip(starts.tolist(), stop.tolist())]


_IRREGULAR = re.compile(r" \s|\s | $")
_CLEAN = re.compile(r"(?<=\S) (?=\S)")


def units(text: str) -> list[str]:
    """The text cut before single blanks between other characters; no word of the pattern crosses such a cut."""
    parts = _CLEAN.split(text) if _IRREGULAR.search(text) else text.split(" ")
    out = [parts[0]] if parts[0] else []
    out.extend([" " + p for p in parts[1:]])
    return out


class Encoder:
    """Encodes texts; keeps the ids of units seen before, within a bound."""

    def __init__(self, ranks: dict[bytes, int], merges: dict, pattern: str = PATTERN):
        self.replay, self.split = Replay(ranks, merges), regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        cut = [units(t) for t in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        new = list({u for c in cut for u in c if u not in self.known})
        words = [self.split(u) for u in new]
        distinct = list({w for ws in words for w in ws})
        ids = dict(zip(distinct, self.replay([w.encode("utf-8", "surrogatepass") for w in distinct])))
        self.known.update((u, b"".join([ids[w] for w in ws])) for u, ws in zip(new, words))
        known = self.known
        return [np.frombuffer(b"".join([known[u] for u in c]), self.replay.kind) for c in cut]


def encode_corpus(docs: DataFrame, ranks_path: str, text: str = "text", key: str = "doc_id", pattern: str = PATTERN) -> DataFrame:
    """``key`` and ``ids``: the token ids of each row's text, without special tokens.

    Null and empty texts have the empty list; strings that look like special tokens are
    ordinary text; the text is taken as it is, never normalised or cut. One narrow stage: each
    task replays the merges over the distinct words of its own texts, and keeps a bounded
    number of them, hence nothing is shuffled and no word list grows with the collection. The
    vocabulary, a file of fixed size at ``ranks_path`` on the driver, is sent to the tasks once.
    Repeated rows come out as often as they come in; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    sent = spark.sparkContext.broadcast((ranks, merges_of(ranks)))

    def encode(batches):
        encoder = Encoder(*sent.value, pattern)
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(np.fromiter(map(len, texts), np.int64, len(texts)), 3_000_000):
                got = encoder(texts[a:b])
                ends = np.r_[0, np.cumsum([len(g) for g in got])].astype(np.int32)
                values = np.concatenate(got).astype(np.int32) if got else np.zeros(0, np.int32)
                yield pa.record_batch([keys.slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")
