"""Groups of near-duplicate texts: a binary-trie self-join under a Hamming error budget."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stage
from .arrays import mix, product, triangle
from .groups import hash_to_min
from .shingles import alike_sizes, bands_of, budget, counters_for, distinct_shingles, folded, frequencies, latest, parts, positions_allow, prefixes, sizes_of, text_rows, verified, wide_parity, widths_of
from .sketch import merged

#: A shingle in more texts than this is compared chunk against chunk, each pair of chunks a key of its own.
CHUNK = 4096
#: Texts of a star from which on its members, known to be one group, are not compared with each other.
GROUP = 64
#: Hash functions by which a text looks for a centre, and how many must name it.
TRIES, AGREE = 6, 2
_LEAF = 16


def star_links(texts: DataFrame) -> DataFrame:
    """Pairs of text ids (``a``, ``b``) of a text and a centre that it may be alike to, at most ``TRIES / AGREE`` a text.

    Under each of some hash functions alike sets mostly have one smallest hash, and the smallest id with that
    hash is the centre: an aggregate with partial sums, and a join with one row a hash. ``AGREE`` of them must name the same. A large group of near-copies is so
    tied together by as many links as it has members instead of all its pairs. What is not found here is found by the trie.
    """

    def least(batches):
        for block, ids, _ in parts(batches):
            row, h = distinct_shingles(block)
            n, start = sizes_of(row, len(block))
            some = np.flatnonzero(n)
            if len(some):
                low = [mix(np.minimum.reduceat(mix(h ^ np.uint64(0x9E3779B9 * (j + 1))), start[some]) + np.uint64(j)) for j in range(TRIES)]
                yield pa.record_batch([np.tile(ids[some], TRIES), np.concatenate(low).view(np.int64)], ["id", "low"])

    lows = texts.select("id", "text").mapInArrow(least, "id long, low long")
    centres = lows.groupBy("low").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").drop("z")
    return lows.join(centres, "low").where("id <> a").groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= AGREE).select("a", "b")


def trie_pairs(block: np.ndarray, sketches: list[bytes], n: np.ndarray, rank: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one block and of different groups whose sketches differ in no more places than the budget of their sizes.

    A block falls into bands of sizes, each a quarter larger than the one before, so that alike
    sets stand in the same band or in neighbours. The sketches of a band have a width that grows with its sets, and
    so the budget stays under a quarter of it; where the next band is twice as wide, it is folded for the meeting.
    """
    band = bands_of(n)
    width = widths_of(band)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    below = widths_of(band - 1)
    for w in np.unique(width).tolist():
        own, upper = np.flatnonzero(width == w), np.flatnonzero((below == w) & (width == 2 * w))
        read = lambda at, x: np.frombuffer(b"".join(sketches[i] for i in at.tolist()), ">u8").astype(np.uint64).reshape(len(at), x // 64)
        bits = np.concatenate([read(own, w), folded(read(upper, 2 * w))])
        at = np.r_[own, upper]
        i, j = _of_one_width(block[at], bits, band[at], n[at], rank[at], group[at], np.r_[np.ones(len(own), bool), np.zeros(len(upper), bool)])
        found.append((at[i], at[j]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _of_one_width(block, bits, band, n, rank, group, own) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of :func:`trie_pairs` of which the smaller set is one of ``own``.

    Sorted by bits, each band is a binary trie in
    place: a node is a range, and a bit splits it where the bit turns 1. All bands descend
    together, bit by bit. A node meets itself as its two halves and as their pair, two nodes meet
    as the four pairs of their halves; a pair of unlike halves has one more differing bit, and a
    pair of nodes goes when its differing bits exceed the largest budget within, or when all
    within are of one group. Small nodes are compared at once.
    """
    words = bits.shape[1]
    order = np.lexsort((*bits.T[::-1], band, block))
    block, band, bits, n, rank, group, own = block[order], band[order], bits[order], n[order].astype(np.int64), rank[order].astype(np.int64), group[order], own[order]
    changes = np.r_[0, np.cumsum(group[1:] != group[:-1])] if len(group) else group
    edge = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (band[1:] != band[:-1])]) if len(block) else np.zeros(0, np.int64)
    lo, hi = edge, np.r_[edge[1:], len(block)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    padded = np.r_[n, 0]

    def most(a, b):
        return np.maximum.reduceat(padded, np.c_[a, b].ravel())[::2] if len(a) else np.zeros(0, np.int64)

    def one(a0, a1, b0, b1):
        """Whether two ranges hold members of a single group."""
        return (changes[a0] == changes[a1 - 1]) & (changes[b0] == changes[b1 - 1]) & (group[a0] == group[b0])

    def leaf(i, j):
        ok = (group[i] != group[j]) & alike_sizes(n[i], n[j]) & positions_allow(n[i], rank[i], n[j], rank[j])
        i, j = i[ok], j[ok]
        far = np.zeros(len(i), np.int64)
        for w in range(words):
            far += np.bitwise_count(bits[i, w] ^ bits[j, w])
        ok = far <= budget(n[i], n[j])
        found.append((order[i[ok]], order[j[ok]]))

    def descend(lo, hi, a0, a1, b0, b1):
        err = np.zeros(len(a0), np.int64)
        for d in range(64 * words):
            small = hi - lo <= 4
            leaf(*triangle(lo[small], hi[small]))
            lo, hi = lo[~small], hi[~small]
            small = (a1 - a0) * (b1 - b0) <= _LEAF
            leaf(*product(a0[small], a1[small], b0[small], b1[small]))
            a0, a1, b0, b1, err = (x[~small] for x in (a0, a1, b0, b1, err))
            if not len(lo) and not len(a0):
                return
            ones = np.r_[0, np.cumsum((bits[:, d // 64] >> np.uint64(63 - d % 64)) & np.uint64(1))].astype(np.int64)
            mid, am, bm = hi - (ones[hi] - ones[lo]), a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
            parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), (am, a1, b0, bm, err + 1), (lo, mid, mid, hi, np.ones(len(lo), np.int64))]
            a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*parts))
            some = (a1 > a0) & (b1 > b0)
            a0, a1, b0, b1, err = (x[some] for x in (a0, a1, b0, b1, err))
            near = (err <= budget(most(a0, a1), most(b0, b1))) & ~one(a0, a1, b0, b1)
            a0, a1, b0, b1, err = (x[near] for x in (a0, a1, b0, b1, err))
            lo, hi = np.r_[lo, mid], np.r_[mid, hi]
            some = hi - lo > 1
            lo, hi = lo[some], hi[some]
            some = changes[lo] != changes[hi - 1]
            lo, hi = lo[some], hi[some]
        leaf(*triangle(lo, hi))
        leaf(*product(a0, a1, b0, b1))

    next_ = np.flatnonzero((block[edge[1:]] == block[edge[:-1]]) & (band[edge[1:]] == band[edge[:-1]] + 1) & own[edge[:-1]])
    size = hi - lo
    size[next_] += hi[next_ + 1] - lo[next_ + 1]
    work = np.cumsum(size * size) // 4_000_000
    alone = (hi - lo > 1) & own[edge]
    for w in np.unique(work):
        single, other = (work == w) & alone, next_[work[next_] == w]
        descend(lo[single], hi[single], lo[other], hi[other], lo[other + 1], hi[other + 1])
    return (np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])) if found else (np.zeros(0, np.int64),) * 2


def group_counters(texts: DataFrame, counters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The counters of :func:`frequencies` on which texts of large groups fall, how many, and the least and greatest mark of such a group.

    No more than the frequencies, and empty where there is no large group.
    """
    top = 2**31 - 1

    def count(batches):
        out = np.zeros((counters, 3), np.int32)
        for block, _, groups in parts(batches, "group"):
            row, h = distinct_shingles(block)
            c = (h % np.uint64(counters)).astype(np.int64)
            m = _marks(np.array(groups, np.int64))[row]
            np.add.at(out[:, 0], c, 1)
            np.maximum.at(out[:, 1], c, top - m)
            np.maximum.at(out[:, 2], c, m)
        return out.ravel()

    def join(a, b):
        a, b = a.reshape(-1, 3), b.reshape(-1, 3)
        out = np.maximum(a, b)
        out[:, 0] = np.minimum(a[:, 0].astype(np.int64) + b[:, 0], top)
        return out.ravel()

    out = merged(texts.where("large").select("id", "text", "group"), count, 3 * counters, np.int32, join).reshape(-1, 3)
    used = np.flatnonzero(out[:, 0])
    return used, out[used, 0].copy(), top - out[used, 1], out[used, 2].copy()


def _marks(groups: np.ndarray) -> np.ndarray:
    return (mix(groups.view(np.uint64)) >> np.uint64(34)).astype(np.int32) | 1


def _spread(own: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as ``times`` says, and a running number for each."""
    again = np.repeat(np.arange(len(own)), times)
    return again, np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)


def block_keys(key: np.ndarray, ids: np.ndarray, f: np.ndarray, heavy_f: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of each row: its index and the block's key, so that no block grows with its shingle.

    ``f`` counts the texts with the shingle, ``heavy_f`` those of one large group, ``heavy`` tells whether the
    row is of it. The others are cut into chunks, and each pair of chunks is a block. The large
    group's members, which need not meet each other, are cut into chunks too, and each of these
    meets each chunk of the others.
    """
    parts, heavy_parts = (f - heavy_f) // CHUNK + 1, np.where(heavy_f > 0, heavy_f // CHUNK + 1, 0)
    spot = mix(ids.view(np.uint64))
    own = (spot % parts.astype(np.uint64)).astype(np.int64)
    light = np.flatnonzero(~heavy)
    again, other = _spread(light, parts[light])
    i = light[again]
    pair = (np.minimum(own[i], other) << 20 | np.maximum(own[i], other)).astype(np.uint64)
    out, keys = [i], [np.where(parts[i] > 1, mix(key[i] ^ mix(pair)), key[i])]
    if heavy_f.any():
        tag = np.uint64(1) << np.uint64(60)
        again, other = _spread(light, heavy_parts[light])
        i = light[again]
        out.append(i)
        keys.append(mix(key[i] ^ mix((own[i] << 20 | other).astype(np.uint64) | tag)))
        dense = np.flatnonzero(heavy)
        again, other = _spread(dense, np.where(f[dense] > heavy_f[dense], parts[dense], 0))  # a shingle of the group alone joins nothing
        i = dense[again]
        mine = (spot[i] % heavy_parts[i].astype(np.uint64)).astype(np.int64)
        out.append(i)
        keys.append(mix(key[i] ^ mix((other << 20 | mine).astype(np.uint64) | tag)))
    return np.concatenate(out), np.concatenate(keys)


def trie_candidates(rows: DataFrame, counts: np.ndarray, large: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """Pairs of text ids of different groups that share a prefix shingle and pass the trie self-join of its block.

    ``rows`` has ``id``, ``text``, ``group`` (the text's own id, or that of its large group) and ``large``.
    """
    shared = rows.sparkSession.sparkContext.broadcast((counts, *large))  # 16 MB, with all counters in use by large groups 96 MB, at most

    def emit(batches):
        f, used, heavy_f, low, high = shared.value
        for texts, ids, groups in parts(batches, "group"):
            group = np.array(groups, np.int64)
            row, h = distinct_shingles(texts)
            at, rank, n = prefixes(row, h, len(texts), f)
            bits = pa.array(wide_parity(row, h, n), pa.binary())
            r, key = row[at], h[at]
            c = (key % np.uint64(len(f))).astype(np.int64)
            dense, heavy = np.zeros(len(c), np.int64), np.zeros(len(c), bool)
            if len(used):
                u = np.minimum(np.searchsorted(used, c), len(used) - 1)
                single = (used[u] == c) & (low[u] == high[u])  # with several large groups on a counter all of them are cut as the others are
                dense = np.minimum(np.where(single, heavy_f[u], 0), f[c])
                heavy = single & (dense > 0) & (_marks(group)[r] == high[u])
            i, key = block_keys(key, ids[r], f[c], dense, heavy)
            r, rank = r[i], rank[i]
            yield pa.record_batch([key.view(np.int64), ids[r], group[r], n[r] << 32 | rank, bits.take(pa.array(r))], ["k", "id", "grp", "place", "bits"])

    def meet(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        k, ids, group, place = (t.column(c).to_numpy() for c in ("k", "id", "grp", "place"))
        i, j = trie_pairs(k, t.column("bits").to_pylist(), place >> 32, place & 0xFFFFFFFF, group)
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        pairs = np.unique(np.c_[a, b][a < b], axis=0)
        yield pa.record_batch([pairs[:, 0].copy(), pairs[:, 1].copy()], ["a", "b"])

    keyed = rows.select("id", "text", "group").mapInArrow(emit, "k long, id long, grp long, place long, bits binary")
    return keyed.repartition("k").mapInArrow(meet, "a long, b long").distinct()


def near_duplicate_groups(docs: DataFrame, lines: str = "lines", least: int = 20) -> DataFrame:
    """Documents in groups of at least two that are alike: ``doc_id``, ``group_id``.

    Two texts (lines joined, signs of loss left out) are alike if both have ``least`` letters and
    their sets of 5-letter shingles have a Jaccard similarity of 0.8 or more. Groups are
    connected components; ``group_id`` is the smallest ``doc_id``. Equal texts are one node
    whatever their number, and a large group of near-copies is first tied to common centres, each
    tie verified, so that its members are compared with all others but not with each other.

    Of a document delivered again the last delivery counts (ties: the greatest text hash). Null
    or empty lines, short texts and null ids give no row; null lines in the list count as
    empty; no input rows give none; further columns are ignored.
    """
    stage = Stage(docs.sparkSession, "near")
    rows = text_rows(docs.select("doc_id", F.col(lines).alias("lines"), *(["loaded_at"] if "loaded_at" in docs.columns else [])), 0)
    member = stage.save(latest(rows.withColumn("size", F.length("text")), "id", "size").where(F.col("size") >= least).select("doc_id", "id"))
    texts = stage.save(rows.where(F.length("text") >= least).select("id", "text").join(member.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]))
    stars = stage.save(verified(stage.save(star_links(texts)), texts, stage).select("a", "b"))
    centre = hash_to_min(stars)
    large = centre.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= GROUP).select("root")
    tied = stage.save(centre.join(large, "root", "left_semi").select(F.col("vertex").alias("id"), F.col("root").alias("group")))
    known = stage.save(texts.join(tied, "id", "left").select("id", "text", F.coalesce("group", "id").alias("group"), F.col("group").isNotNull().alias("large")))
    counters = counters_for(texts.agg(F.sum(F.length("text"))).first()[0] or 0)
    pairs = stage.save(trie_candidates(known, frequencies(texts, counters), group_counters(known, counters)))
    links = stars.union(stage.save(verified(pairs, texts, stage).select("a", "b"))).distinct()
    root = hash_to_min(links).withColumnRenamed("vertex", "id")
    grouped = stage.save(member.join(root, "id", "left").select("doc_id", F.coalesce("root", "id").alias("root")))
    named = grouped.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return grouped.join(named, "root").select("doc_id", "group_id")
