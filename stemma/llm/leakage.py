"""Evaluation texts that leak into training text: rare n-gram seeds and Smith-Waterman alignment."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stage
from .arrays import blocks, rolling
from .sketch import merged, sized

#: Letters of a seed, seeds on near diagonals that a candidate has, and the share of the corpus' n-grams (over 100 of them) from which on one is common.
SEED, ENOUGH, COMMON = 8, 6, 1e-4
#: Most bits of the field of the items' n-grams (256 MB), and most letters of items that are broadcast to a join (of more, the join is shuffled).
MOST_BITS, SMALL = 1 << 31, 2_000_000
#: Diagonals on either side of those of its seeds that an alignment may use.
DRIFT = 16
#: Variants of one letter (fixed values).
SAME = {"ς": "σ", "ϲ": "σ"}


@cache
def _letters() -> np.ndarray:
    """For each code point itself or its plain variant if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = c
    for a, b in SAME.items():
        out[ord(a)] = ord(b)
    return out


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts in a row (decomposed, lower case, plain variants, nothing else), and the end of each text."""
    plain = [unicodedata.normalize("NFD", t).lower() for t in texts]
    ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))
    points = _letters()[np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = points > 0
    return points[keep], np.r_[0, np.cumsum(keep)][ends]


def align(item: np.ndarray, flat: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, width: int, match: int = 2, mismatch: int = -1, gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of an item with many texts at once, each in a band of diagonals, and the longest exact runs there.

    Text i is ``flat[lo[i]:hi[i]]``; its band has the ``width`` diagonals from ``start[i]`` on, the first of
    which holds the item's letter n against ``flat[start[i] + n]``. Rows are letters of the item; the gap along a row is a running maximum.
    """
    n, ramp = len(start), gap * np.arange(width)
    score, run = np.zeros((n, width + 1), np.int64), np.zeros((n, width), np.int64)
    best, longest = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = start[:, None] + np.arange(width)
    for c in item.tolist():
        there = (at >= lo[:, None]) & (at < hi[:, None])
        same = there & (flat[np.clip(at, 0, len(flat) - 1)] == c)
        row = np.maximum(score[:, :-1] + np.where(same, match, mismatch), score[:, 1:] - gap)
        np.maximum(row, 0, out=row)
        row[~there] = 0
        row = np.maximum.accumulate(row + ramp, axis=1) - ramp
        row[~there] = 0
        score[:, :-1] = row
        run = np.where(same, run + 1, 0)
        np.maximum(best, row.max(1), out=best)
        np.maximum(longest, run.max(1), out=longest)
        at += 1
    return best, longest


def bands(diagonals: list[int]) -> list[int]:
    """The first diagonals of bands, ``4 * DRIFT + 1`` wide, that hold each of the given ones with ``DRIFT`` on both sides."""
    out: list[int] = []
    for d in sorted(diagonals):
        if not out or d > out[-1] + 2 * DRIFT:
            out.append(d - DRIFT)
    return out


def seeds_of(counts: np.ndarray, common: float, w: int, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of an item's seeds by the corpus' counts of its n-grams, and whether one hit suffices there.

    Seeds are the n-grams that the corpus has and that are not common, and in every stretch of ``w`` n-grams the rarest that it has.
    In a stretch with fewer than ``enough`` that are not common, one hit suffices: so an exact copy of any stretch is a candidate.
    """
    if not len(counts):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    w = min(w, len(counts))
    rare = (counts > 0) & (counts <= common)
    rank = np.empty(len(counts), np.int64)
    rank[np.lexsort((np.arange(len(counts)), counts, counts == 0))] = np.arange(len(counts))
    start = np.arange(len(counts) - w + 1)
    best = np.lib.stride_tricks.sliding_window_view(rank, w).argmin(1) + start
    few = np.flatnonzero(np.convolve(rare, np.ones(w, np.int64), "valid") < enough)
    step = np.zeros(len(counts) + 1, np.int64)
    np.add.at(step, few, 1)
    np.add.at(step, few + w, -1)
    keep = rare.copy()
    keep[best] = True
    at = np.flatnonzero(keep & (counts > 0))
    return at, np.cumsum(step)[at] > 0


def _parts(batches):
    """Blocks of texts: their row numbers in the batch, letters in a row and ends, and the batch."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in blocks(np.fromiter(map(len, texts), np.int64, len(texts))):
            yield batch, np.arange(a, b), *letters(texts[a:b])


def _grams(flat: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place in its text of every n-gram that lies in one text."""
    h = rolling(flat, k)
    row = np.searchsorted(ends, np.arange(len(h)), "right")
    ok = np.arange(len(h)) + k <= ends[np.minimum(row, len(ends) - 1)] if len(h) else np.zeros(0, bool)
    return h[ok], row[ok], np.flatnonzero(ok) - np.r_[0, ends][row[ok]]


def _bit(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return ((h >> np.uint64(3)) % np.uint64(size)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8)


def leaked_items(docs: DataFrame, items: DataFrame, least: int = 48, k: int = SEED, enough: int = ENOUGH, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """Documents that hold a passage of an item, exactly or edited: ``key``, ``item``, ``run``, ``score``, ``share``.

    Texts are reduced to letters (NFD, lower case, variants of sigma as one, category L only).

    1. A bit field, sized by the items' letters, tells the corpus in one pass which of its n-grams of ``k`` letters
       may be the items'; these go on as hashes with document and place.
    2. They are counted over the whole corpus. Seeds of an item are its n-grams that are rare there, no more than one in ten
       thousand (``COMMON``), and the rarest of each stretch of ``least`` letters; they are joined with the corpus' n-grams by hash. A
       candidate has ``enough`` seeds on diagonals within 16 letters; where a stretch has fewer that are rare, one is enough.
    3. Candidates are aligned (Smith-Waterman: 2 a match, -1 a mismatch or gap) in bands around the seeds'
       diagonals. A row is a pair whose ``score`` is that of ``least`` equal letters or more, ``2 * least``; ``share`` is its part of
       the score of the whole item, ``run`` the longest exact run of letters in the bands.

    No pair with an exact run of ``least`` letters is missed. An edited copy is found if enough seeds stand in it unedited and
    its gaps drift by no more than ``DRIFT`` letters from there; recall by rate of edits is measured in the tests and stated in the README.
    In a corpus of many times 10^10 letters chance alone repeats eight letters: ``k`` of 10 to 12 then keeps candidates few, at some recall.

    Items may be as many as documents: neither they nor counts of them go to the driver. Null and empty texts, items under ``k``
    letters and null ids give no rows; a pair comes once, with its best values, however often rows are repeated;
    empty tables give none; further columns are ignored.
    """
    if not k <= least:
        raise ValueError("seeds must fit the passages")
    stage = Stage(docs.sparkSession, "leaks")
    rows = docs.where(F.col(key).isNotNull() & (F.length(text) >= k)).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("version"))

    def plain(batches):
        for batch, own, flat, ends in _parts(batches):
            bodies = [flat[a:b].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(np.r_[0, ends], ends)]
            yield pa.record_batch([batch.column("id").take(pa.array(own)), pa.array(bodies, pa.string())], ["item", "body"])

    asked = items.where(F.col(item).isNotNull() & (F.length(text) >= k)).select(F.col(item).cast("long").alias("id"), F.col(text).alias("text"))
    asked = stage.save(asked.mapInArrow(plain, "item long, body string").where(F.length("body") >= k).distinct().withColumn("num", F.monotonically_increasing_id()))
    total = asked.agg(F.sum(F.length("body"))).first()[0] or 0

    def grams_of(batches):
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            flat = np.frombuffer("".join(bodies).encode("utf-32-le", "surrogatepass"), np.uint32)
            h, row, at = _grams(flat, np.cumsum([len(b) for b in bodies]), k)
            yield pa.record_batch([batch.column("num").take(pa.array(row)), pa.array(at), pa.array(h.view(np.int64))], ["num", "at", "gram"])

    grams = stage.save(asked.select("num", "body").mapInArrow(grams_of, "num long, at long, gram long"))
    size = sized(16 * total, 1 << 20, MOST_BITS) // 8

    def mark(batches):
        field = np.zeros(size, np.uint8)
        for batch in batches:
            at, bit = _bit(batch.column("gram").to_numpy().view(np.uint64), size)
            np.bitwise_or.at(field, at, bit)
        return field

    sent = docs.sparkSession.sparkContext.broadcast(merged(grams.select("gram"), mark, size, np.uint8, np.bitwise_or))

    def scan(batches):
        field = sent.value
        for batch, own, flat, ends in _parts(batches):
            h, row, place = _grams(flat, ends, k)
            at, bit = _bit(h, size)
            ok = field[at] & bit > 0
            i = pa.array(own[row[ok]])
            yield pa.record_batch([batch.column("id").take(i), batch.column("version").take(i), pa.array(place[ok]), pa.array(h[ok].view(np.int64))], ["id", "version", "place", "gram"])

    hits = stage.save(rows.mapInArrow(scan, "id long, version long, place long, gram long"))
    counts = hits.groupBy("gram").agg(F.count("*").alias("n"))
    common = 100 + COMMON * (rows.agg(F.sum(F.length("text"))).first()[0] or 0)

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        at, alone = seeds_of(table.column("n").to_numpy(), common, least - k + 1, enough)
        return table.take(pa.array(at)).select(["num", "at", "gram"]).append_column("alone", pa.array(alone))

    seeds = stage.save(grams.join(counts, "gram", "left").select("num", "at", "gram", F.coalesce("n", F.lit(0)).alias("n")).groupBy("num").applyInArrow(choose, "num long, at long, gram long, alone boolean"))
    # two grids of diagonals, so that any two within half a cell share one
    met = hits.join(seeds, "gram").withColumn("d", F.col("place") - F.col("at"))
    cell = F.explode(F.array(F.floor(F.col("d") / (2 * DRIFT)) * 2, F.floor((F.col("d") + DRIFT) / (2 * DRIFT)) * 2 + 1))
    cells = met.select("id", "version", "num", "d", "alone", cell.alias("cell")).groupBy("id", "version", "num", "cell").agg(F.count("*").alias("n"), F.max("alone").alias("alone"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    pairs = cells.where((F.col("n") >= enough) | F.col("alone")).groupBy("id", "version", "num").agg(F.array_distinct(F.flatten(F.collect_set(F.array("lo", "hi")))).alias("diagonals"))
    bodies = asked.select("num", "item", "body")
    pairs = pairs.join(F.broadcast(bodies) if total <= SMALL else bodies, "num")
    both = pairs.join(rows, ["id", "version"]).select("id", "text", "num", "item", "body", "diagonals")

    def match(batches):
        for batch in batches:
            nums, bodies_, diagonals = (batch.column(c).to_pylist() for c in ("num", "body", "diagonals"))
            for a, b in blocks(np.fromiter(map(len, batch.column("text").to_pylist()), np.int64, batch.num_rows)):
                flat, ends = letters(batch.column("text").slice(a, b - a).to_pylist())
                begins = np.r_[0, ends[:-1]]
                jobs: dict[int, list[tuple[int, int]]] = {}
                for i in range(a, b):
                    jobs.setdefault(nums[i], []).extend((i, begins[i - a] + d) for d in bands(diagonals[i]))
                best, longest = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                for todo in jobs.values():
                    of = bodies_[todo[0][0]]
                    own = np.frombuffer(of.encode("utf-32-le", "surrogatepass"), np.uint32)
                    for c in range(0, len(todo), 10_000):
                        i, start = np.array(todo[c : c + 10_000]).T
                        got = align(own, flat, begins[i - a], ends[i - a], start, 4 * DRIFT + 1)
                        np.maximum.at(best, i - a, got[0])
                        np.maximum.at(longest, i - a, got[1])
                size_ = np.array([len(x) for x in bodies_[a:b]])
                ok = np.flatnonzero(best >= 2 * least)
                i = pa.array(a + ok)
                yield pa.record_batch([batch.column("id").take(i), batch.column("item").take(i), pa.array(longest[ok].astype(np.int32)), pa.array(best[ok].astype(np.int32)), pa.array(best[ok] / (2 * size_[ok]), pa.float64())], ["id", "item", "run", "score", "share"])

    found = both.mapInArrow(match, "id long, item long, run int, score int, share double")
    out = found.groupBy("id", "item").agg(F.max("run").alias("run"), F.max("score").alias("score"), F.max("share").alias("share"))
    return out.select(F.col("id").cast(docs.schema[key].dataType).alias(key), F.col("item").cast(items.schema[item].dataType).alias(item), "run", "score", "share")
