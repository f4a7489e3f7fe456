"""How distinctive a term is for a record: residual inverse document frequency."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, flat, inside, mix
from .sketch import merged, sized

#: Most bits of the field of marked terms (32 MB).
MOST_BITS = 1 << 28


def _hash(points: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(points) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + points[i : len(points) - k + 1 + i]
    return mix(out)


def term_counts(texts: list[str], k: int, barriers: str, least: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of the terms that occur ``least`` times or more in a text; overlapping occurrences count.

    The block's own alphabet numbers its letters, so that a term and its row fit a word
    exactly; a block with more than 256 letters is counted text by text instead.
    """
    none = np.zeros(0, np.int64), np.zeros(0, f"<U{k}"), np.zeros(0, np.int64)
    points, row, ends = flat(texts)
    if len(points) < k:
        return none
    ok = inside(row, ends, k)
    bad = np.r_[0, np.cumsum(np.isin(points, [ord(c) for c in barriers]))]
    ok &= bad[k:] == bad[:-k]
    if wanted is not None:
        h = _hash(points, k)
        ok &= (wanted[(h >> np.uint64(3)) % np.uint64(len(wanted))] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    pos = np.flatnonzero(ok)
    if not len(pos):
        return none
    alphabet = np.unique(points)
    if len(alphabet) > 256 or k > 6 or len(texts) > 65535:
        at: dict = {}
        whole = "".join(texts)
        for p in pos.tolist():
            key = (int(row[p]), whole[p : p + k])
            at[key] = at.get(key, 0) + 1
        got = [(r, t, n) for (r, t), n in at.items() if n >= least]
        return (np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got], f"<U{k}"), np.array([g[2] for g in got], np.int64)) if got else none
    local = np.searchsorted(alphabet, points).astype(np.uint64)
    key = row[pos].astype(np.uint64)
    for i in range(k):
        key = key << np.uint64(8) | local[pos + i]
    key.sort()
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n = np.diff(np.r_[edge, len(key)])
    edge, n = edge[n >= least], n[n >= least]
    key = key[edge]
    letters = np.stack([alphabet[(key >> np.uint64(8 * (k - 1 - i)) & np.uint64(255)).astype(np.int64)] for i in range(k)], 1).astype(np.uint32)
    return (key >> np.uint64(8 * k)).astype(np.int64), np.ascontiguousarray(letters).view(f"<U{k}")[:, 0] if len(letters) else none[1], n


def distinctive_terms(docs: DataFrame, lines: str = "lines", k: int = 6, barriers: str = "▯\n", min_count: int = 1) -> DataFrame:
    """Terms of each document with their scores: ``doc_id``, ``term``, ``tf``, ``df``, ``cf``, ``ridf``, ``score``.

    A term is ``k`` characters in a row inside one line, none of them a barrier. ``df`` and ``cf``
    count documents and occurrences over the whole collection of N documents;
    ``ridf = -log2(df / N) + log2(1 - exp(-cf / N))`` is how much rarer in documents the term is than
    its occurrences, scattered at random (Poisson), would make it; ``score = tf * ridf``.

    ``min_count`` only chooses the rows that are returned, tf at least that; counts always
    cover all documents. Since then only terms matter that some document has that often, a
    first pass marks these in a bit field sized by the letters (32 MB at most), and the second sends on the counts
    of marked terms alone. A term marked by chance falls out at the end; none is lost.

    Of a document delivered more than once each term has the largest of its counts, so repeated
    rows change nothing. Null or empty lists, null lines and null ids give no terms (documents
    without terms count for N); an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select("doc_id", F.array_join(lines, "\n").alias("text"))
    texts = rows.where(F.length("text") >= k)

    def parts(batches):
        for batch in batches:
            t = batch.column("text").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            for a, b in blocks(np.fromiter(map(len, t), np.int64, len(t))):
                yield ids[a:b], t[a:b]

    wanted = None
    if min_count > 1:
        letters = texts.agg(F.sum(F.length("text"))).first()[0] or 0
        size = sized(letters // min_count, 1 << 16, MOST_BITS) // 8  # no more terms can be marked than have room, however often they stand

        def mark(batches):
            field = np.zeros(size, np.uint8)
            for _, t in parts(batches):
                _, term, _ = term_counts(t, k, barriers, min_count)
                if len(term):
                    h = _hash(np.ascontiguousarray(term).view(np.uint32), k)[::k]
                    np.bitwise_or.at(field, ((h >> np.uint64(3)) % np.uint64(size)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
            return field

        wanted = spark.sparkContext.broadcast(merged(texts.select("doc_id", "text"), mark, size, np.uint8, np.bitwise_or))

    def count(batches):
        for ids, t in parts(batches):
            row, term, n = term_counts(t, k, barriers, 1, wanted.value if wanted else None)
            yield pa.record_batch([pa.array([ids[i] for i in row.tolist()], pa.string()), pa.array(term.tolist(), pa.string()), pa.array(n, pa.int64())], ["doc_id", "term", "tf"])

    total = rows.select("doc_id").distinct().count()
    per = texts.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(count, "doc_id string, term string, tf long").groupBy("term", "doc_id").agg(F.max("tf").alias("tf"))
    stats = per.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("most")).where(F.col("most") >= min_count)
    ridf = -F.log2(F.col("df") / F.lit(float(max(total, 1)))) + F.log2(-F.expm1(-F.col("cf") / F.lit(float(max(total, 1)))))
    return per.where(F.col("tf") >= min_count).join(stats, "term").withColumn("ridf", ridf).select("doc_id", "term", "tf", "df", "cf", "ridf", (F.col("tf") * F.col("ridf")).alias("score"))
