"""Shared ground of the operators on letter shingles: texts, frequencies, prefixes, parity bits.

Two sets with a Jaccard similarity of at least 4/5 share one of their first
``n - ceil(4n/5) + 1`` elements under any order that is the same for both sets. The order here is
rarest first, by counters, sized from the letters of all texts, that all documents fill; counters may
overestimate, which changes the work and never the result. A counter of 1 proves that
no other text holds the shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, flat, inside, rolling
from .sketch import merged, saturating, sized

GAP = "▯"
K = 5
#: Most counters (16 MB).
MOST_COUNTERS = 1 << 22
H = 48
#: Bits of the sketch of a set, at least and at most.
LEAST_BITS, MOST_BITS = 256, 4096


def letters_of(lines: Column | str) -> Column:
    """The text of a document: its lines joined with nothing between, without signs of loss."""
    return F.replace(F.array_join(lines, ""), F.lit(GAP), F.lit(""))


def text_rows(docs: DataFrame, least: int = 20, lines: str = "lines") -> DataFrame:
    """Deliveries with a text of ``least`` letters: ``doc_id``, ``text``, ``id`` (of the text), ``at``.

    ``id`` is a 64-bit hash of the text. Should two different texts of the collection ever have
    the same, which is tested, another seed is taken, so that equal ids mean equal texts.
    """
    at = F.col("loaded_at").cast("timestamp") if "loaded_at" in docs.columns else F.lit(None).cast("timestamp")
    rows = docs.where("doc_id is not null").select("doc_id", letters_of(lines).alias("text"), at.alias("at"), *(["split"] if "split" in docs.columns else [])).where(F.length("text") >= least)
    for seed in range(8):
        named = rows.withColumn("id", F.xxhash64("text") if not seed else F.xxhash64(F.lit(seed), "text"))
        proof = named.groupBy("id").agg(F.min(F.md5("text")).alias("a"), F.max(F.md5("text")).alias("b"))
        if not proof.where("a <> b").limit(1).count():
            return named
    raise RuntimeError("no seed without collision")


def latest(rows: DataFrame, *columns: str) -> DataFrame:
    """Of each ``doc_id`` the last delivery's columns; of equal times the greatest values."""
    return rows.groupBy("doc_id").agg(F.max(F.struct("at", *columns)).alias("x")).select("doc_id", *[f"x.{c}" for c in columns])


def distinct_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and 48-bit hash of each distinct shingle, ordered by row and hash."""
    points, row, ends = flat(texts)
    h = rolling(points, K)
    ok = inside(row, ends, K)
    key = (row[: len(h)][ok].astype(np.uint64) << np.uint64(H)) | (h[ok] >> np.uint64(64 - H))
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return (key >> np.uint64(H)).astype(np.int64), key & np.uint64((1 << H) - 1)


def parts(batches: Iterator[pa.RecordBatch], extra: str | None = None) -> Iterator[tuple[list[str], np.ndarray, list]]:
    """Blocks of texts, ids and one further column."""
    for batch in batches:
        ids, texts = batch.column("id").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
        more = batch.column(extra).to_pylist() if extra else [None] * len(texts)
        for a, b in blocks(np.fromiter(map(len, texts), np.int64, len(texts))):
            yield texts[a:b], ids[a:b], more[a:b]


def counters_for(letters: int) -> int:
    """How many counters serve texts of so many letters: a sixteenth, as shingles recur, up to ``MOST_COUNTERS``."""
    return sized(letters // 16, 1 << 16, MOST_COUNTERS)


def frequencies(texts: DataFrame, counters: int) -> np.ndarray:
    """For each of some counters the number of texts with a shingle that falls on it; each text is one row."""

    def count(batches):
        total = np.zeros(counters, np.int32)
        for block, _, _ in parts(batches):
            _, h = distinct_shingles(block)
            total += np.bincount((h % np.uint64(counters)).astype(np.int64), minlength=counters).astype(np.int32)
        return total

    return merged(texts.select("id", "text"), count, counters, np.int32, saturating)


def sizes_of(row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.bincount(row, minlength=rows)
    return n, np.cumsum(n) - n


def prefixes(row: np.ndarray, h: np.ndarray, rows: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which shingles (indexes) belong to their text's prefix and stand in another text, their rank, and the sizes of all texts."""
    n, start = sizes_of(row, rows)
    f = counts[(h % np.uint64(len(counts))).astype(np.int64)]
    order = np.argsort((row.astype(np.uint64) << np.uint64(32)) | f.astype(np.uint64), kind="stable")  # ties stay ordered by hash: one order for all texts
    rank = np.arange(len(row)) - start[row[order]]
    keep = (rank < (n - (4 * n + 4) // 5 + 1)[row[order]]) & (f[order] > 1)
    return order[keep], rank[keep], n


def parity(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """256 bits a text: bit b tells whether an odd number of its shingles fall on b.

    An element of only one of two sets turns one bit at most, hence the bits of two texts
    differ in no more places than their sets have elements of only one.
    """
    out = np.zeros((rows, 4), np.uint64)
    n, start = sizes_of(row, rows)
    some = n > 0
    bit = np.uint64(1) << (h & np.uint64(63))
    word = (h >> np.uint64(6)) & np.uint64(3)
    for j in range(4):
        if len(h):
            out[some, j] = np.bitwise_xor.reduceat(np.where(word == j, bit, np.uint64(0)), start[some])
    return out


def bands_of(n: np.ndarray) -> np.ndarray:
    """Bands of sizes, each a quarter larger than the one before: alike sets stand in one band or in neighbours."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1.2500001)).astype(np.int64)


def widths_of(band: np.ndarray) -> np.ndarray:
    """Bits of a sketch in each band: the power of two that holds the largest set of the band, ``LEAST_BITS`` to ``MOST_BITS``.

    Sets without anything in common differ in two fifths of such bits or more, alike ones in less than a quarter.
    """
    top = np.ceil(np.log2(np.maximum(1.0, 1.2500001 ** (band + 1.0))))
    return (1 << np.clip(top, np.log2(LEAST_BITS), np.log2(MOST_BITS)).astype(np.int64)).astype(np.int64)


def wide_parity(row: np.ndarray, h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Parity bits of each text, as many as its size asks for: bit b tells whether an odd number of its shingles fall on b."""
    width = widths_of(bands_of(n))
    start = np.cumsum(width) - width
    odd = np.bincount(start[row] + (h & (width[row] - 1).astype(np.uint64)).astype(np.int64), minlength=int(width.sum())).astype(np.uint8) & 1
    packed = np.packbits(odd, bitorder="big").tobytes()
    return [packed[a // 8 : (a + w) // 8] for a, w in zip(start.tolist(), width.tolist())]


def folded(bits: np.ndarray) -> np.ndarray:
    """Sketches of half the width: those of the same sets."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def alike_sizes(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return 5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)


def budget(na, nb):
    """Elements of only one set that two alike sets of these sizes may have."""
    return (na + nb) // 9


def positions_allow(na, ra, nb, rb) -> np.ndarray:
    """Whether the first common element at these ranks leaves room for the overlap that alike sets need."""
    return 1 + np.minimum(na - ra - 1, nb - rb - 1) >= (4 * (na + nb) + 8) // 9


def similarity(a: str, b: str) -> tuple[int, int]:
    """Common and all distinct shingles of two texts, exactly."""
    x, y = ({t[i : i + K] for i in range(len(t) - K + 1)} for t in (a, b))
    common = len(x & y)
    return common, len(x) + len(y) - common


def verified(pairs: DataFrame, rows: DataFrame, stage) -> DataFrame:
    """Pairs of text ids (``a``, ``b``) that are alike exactly, with ``common`` and ``total``.

    Only texts that occur in a pair are shuffled.
    """
    need = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = stage.save(rows.select("id", "text").join(need, "id", "left_semi").dropDuplicates(["id"]))

    def test(batches):
        for batch in batches:
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
            got = [similarity(s, t) for s, t in zip(x, y)]
            keep = [i for i, (c, u) in enumerate(got) if 5 * c >= 4 * u and u]
            yield pa.record_batch([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64()), pa.array([got[i][0] for i in keep], pa.int32()), pa.array([got[i][1] for i in keep], pa.int32())], ["a", "b", "common", "total"])

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(test, "a long, b long, common int, total int")
