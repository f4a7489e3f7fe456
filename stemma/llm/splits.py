"""Splits that keep related records together, and the report of those torn apart."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stage

SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}


def read_split(c: Column | str) -> Column:
    """A split name without outer blanks and tabs, in lower case."""
    return F.lower(F.trim(c if isinstance(c, Column) else F.col(c), F.lit(" \t")))


def hook_and_shortcut(edges: DataFrame, record: str = "record", key: str = "key", max_rounds: int = 64) -> DataFrame:
    """Components of records that share a key, over all keys: one row (``record``, ``root``).

    The parent array is a table. A round hooks: every key finds the smallest parent among its
    records, and each parent hooks onto the smallest that any of its keys saw (two aggregates
    with partial sums, so a key or a component with a third of all rows makes no hot task); then
    it shortcuts: each record takes its parent's parent. It ends when no parent changes. Null
    records and keys are left out, repeated rows are without effect.
    """
    stage = Stage(edges.sparkSession, "hook")
    e = stage.save(edges.where(F.col(record).isNotNull() & F.col(key).isNotNull()).select(F.col(record).alias("record"), F.col(key).alias("key")).distinct())
    parent = e.select("record", F.col("record").alias("parent")).distinct()
    moved = None
    for _ in range(max_rounds):
        seen = e.join(parent, "record")
        least = seen.groupBy("key").agg(F.min("parent").alias("least"), F.max("parent").alias("most")).where("least <> most").drop("most")
        hooked = seen.join(least, "key").groupBy("parent").agg(F.min("least").alias("up")).where("up < parent")
        after = parent.join(hooked, "parent", "left").select("record", F.coalesce("up", "parent").alias("new"), (F.col("up").isNotNull()).alias("moved"))
        up = hooked.select(F.col("parent").alias("new"), F.col("up").alias("top"))
        short = stage.save(after.join(up, "new", "left").select("record", F.coalesce("top", "new").alias("parent"), "moved"))
        if moved is not None:
            stage.drop(moved)
        moved = short
        parent = short.select("record", "parent")
        if not short.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError(f"no stable state after {max_rounds} rounds")
    return parent.withColumnRenamed("parent", "root")


def _grown(bits: int, weights: list[int], width: int) -> int:
    """The totals below ``width`` that can be reached from those of ``bits`` with the weights, as a bitset."""
    mask = (1 << width) - 1
    for w in weights:
        if w < width:
            bits |= (bits << w) & mask
    return bits


def _lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def _first(weights: list[int], lo: int, hi: int) -> tuple[int, int] | None:
    """How many of the first weights it takes to reach a total from ``lo`` to ``hi``, and the largest such total; None if all do not.

    A total of weights is the sum of all less the total of those left out, so the bitset need only be as long as the
    smaller of the two; it is begun again at twice the length where it turns out too short.
    """
    sums = [0, *accumulate(weights)]
    start = bisect_left(sums, lo)
    if start == len(sums):
        return None
    if sums[start] <= hi:
        return start, sums[start]
    width = 0
    while True:
        width = max(2 * width, min(hi, sums[start] - lo) + 1)
        bits, mask = _grown(1, weights[: start - 1], width), (1 << width) - 1
        for i in range(start, len(sums)):
            if min(hi, sums[i] - lo) >= width:
                start = i
                break
            if weights[i - 1] < width:
                bits |= (bits << weights[i - 1]) & mask
            if hi < width:
                seen = (bits >> lo) & ((1 << hi - lo + 1) - 1)
                if seen:
                    return i, lo + seen.bit_length() - 1
            else:
                seen = (bits >> sums[i] - hi) & ((1 << hi - lo + 1) - 1)
                if seen:
                    return i, hi - _lowest(seen)
        else:
            return None


def _made_of(weights: list[int], total: int) -> list[int]:
    """Places of weights that sum to ``total``, which can be reached; a later weight is used only where the earlier ones don't do.

    From the last weight to the first, either what is still to be made or what is still to be left out is known. Bitsets
    are made anew for eighths of the weights, so that no more than eight a level are held, and only as far down as these reach.
    """
    sums, places = [0, *accumulate(weights)], []
    turned = 2 * total > sums[-1]

    def back(bits: int, off: int, a: int, b: int, rest: int) -> int:
        if b - a == 1:
            unused = rest - weights[a] if turned else rest
            if unused >= 0 and bits >> unused - off & 1:
                return unused
            places.append(a)
            return rest if turned else rest - weights[a]
        low, step = max(0, rest - sums[b] + sums[a]), (b - a + 7) // 8
        width, cuts = rest - low + 1, range(a, b, step)
        marks = [(bits >> low - off) & ((1 << width) - 1)]
        for c in cuts[1:]:
            marks.append(_grown(marks[-1], weights[c - step : c], width))
        for c in reversed(cuts):
            rest = back(marks.pop(), low, c, min(c + step, b), rest)
        return rest

    if weights:
        back(1, 0, 0, len(weights), sums[-1] - total if turned else total)
    return places


def _around(weights: list[int], target: int, below: int, above: int) -> list[int]:
    """The largest total of weights up to ``target`` and the smallest beyond, where they are no further than ``below`` and ``above``."""
    every = sum(weights)
    if every <= target:
        return [every]
    left = every - target  # what is left out where the target is met
    if target + above <= left + below:
        bits = _grown(1, weights, target + above + 1)
        lower, upper = (bits & ((1 << target + 1) - 1)).bit_length() - 1, bits >> target + 1
        return [lower, target + 1 + _lowest(upper)] if upper else [lower]
    bits = _grown(1, weights, left + below + 1)
    lower, upper = bits >> left, every - (bits & ((1 << left) - 1)).bit_length() + 1
    return [target - _lowest(lower), upper] if lower else [upper]


def _closest(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many groups of each size have a total closest to ``target``, by a bitset of the totals that can be reached.

    The multiplicities enter in binary parts, the largest sizes first, and no more parts than it takes. Groups of one
    record come last, by arithmetic: once a total lies no further below the target than there are of these, the rest is
    theirs. A group larger than the target can only be taken alone. Ties go to the smaller total.
    """
    if target <= 0:
        return {}
    ones, parts = max(0, sizes.get(1, 0)), []
    for size in sorted((s for s, n in sizes.items() if 1 < s <= target and n > 0), reverse=True):
        n, k = min(sizes[size], target // size + 1), 1
        while n > 0:
            parts.append((size, min(k, n)))
            n, k = n - k, 2 * k
    unit = 1 if ones else gcd(*(s for s, _ in parts)) or 1
    weights, over = [s // unit * k for s, k in parts], target % unit
    goal = target // unit + (2 * over > unit)  # no total comes closer than the next multiple
    found = _first(weights, max(0, goal - ones), goal)
    if found:
        used, totals = found[0], [found[1]]
    else:
        rest = target // unit
        for w in weights:
            rest -= w if w <= rest else 0
        used, totals = len(weights), _around(weights, target // unit, rest + 1, max(0, rest - ones) + 1)
    filled = {t * unit + min(ones, max(0, target - t * unit)): t for t in totals}
    alone = sorted(s for s, n in sizes.items() if s > target and n > 0)[:1]
    best = min([*filled, *alone], key=lambda t: (abs(t - target), t))
    if best in alone:
        return {best: 1}
    total = filled[best]
    taken = {1: best - total * unit} if best > total * unit else {}
    for i in _made_of(weights[:used], total):
        size, k = parts[i]
        taken[size] = taken.get(size, 0) + k
    return taken


def _total(taken: dict[int, int]) -> int:
    return sum(s * n for s, n in taken.items())


def subset_sum(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many groups of each size to take so that their total comes closest to ``target``.

    ``sizes`` maps size to multiplicity. First the target's share of the groups of each size is taken, rounded
    down, so that a split has groups of all sizes; the rest, less than one group of each size, is a subset sum over
    what remains. Where that misses the target, the subset sum of the whole is taken instead if it is no further off.
    The rule is the same for all numbers of records.
    """
    sizes = {s: n for s, n in sizes.items() if s > 0 and n > 0}
    whole = _total(sizes)
    if target <= 0 or not whole:
        return {}
    taken = {s: n * min(target, whole) // whole for s, n in sizes.items()}
    for s, n in _closest({s: n - taken[s] for s, n in sizes.items()}, target - _total(taken)).items():
        taken[s] += n
    taken = {s: n for s, n in taken.items() if n}
    if _total(taken) != target:
        taken = min(_closest(sizes, target), taken, key=lambda t: (abs(_total(t) - target), _total(t)))
    return taken


def choose(sizes: dict[int, int], shares: dict[str, float]) -> dict[str, dict[int, int]]:
    """Groups of each size for every split: subset sums for all but the largest, which gets the rest."""
    total, left = sum(s * n for s, n in sizes.items()), dict(sizes)
    main = max(shares, key=shares.get)
    out = {}
    for name in sorted((s for s in shares if s != main), key=lambda s: (-shares[s], s)):
        out[name] = subset_sum(left, round(total * shares[name]))
        for size, n in out[name].items():
            left[size] -= n
    return {main: left} | out


def grouped_split(docs: DataFrame, keys: list[str], shares: dict[str, float] = SHARES, seed: int = 20260913, valid: dict[str, Column] | None = None, buckets: int = 1024) -> DataFrame:
    """One row per ``doc_id``: ``doc_id``, ``group_id``, ``split``; all that share a key stay together.

    ``keys`` are columns such as author, source or entity; a null key ties nothing, and ``valid``
    may say which values count. Groups are components over all keys. Only the histogram of group
    sizes goes to the driver: distinct sizes s sum to at most the number of records N, so there
    are under sqrt(2 N) of them. Which groups of a size go where is decided by a seeded hash of
    the group id: ranks are counted in hash buckets and offset by running totals, never in one
    window over all groups of a size. Empty input gives no rows.
    """
    stage = Stage(docs.sparkSession, "split")
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    edges = None
    for k in keys:
        ok = F.col(k).isNotNull() & (valid or {}).get(k, F.lit(True))
        e = docs.where(ok).select(F.col("doc_id").alias("record"), F.concat(F.lit(f"{k}="), F.col(k).cast("string")).alias("key"))
        edges = e if edges is None else edges.union(e)
    roots = hook_and_shortcut(edges)
    member = stage.save(ids.join(roots.withColumnRenamed("record", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id")))
    h = F.xxhash64(F.lit(seed), F.col("group_id"))
    groups = stage.save(member.groupBy("group_id").agg(F.count("*").alias("size")).select("group_id", "size", F.pmod(h, F.lit(buckets)).cast("int").alias("bucket"), h.alias("h")))
    sizes = {r["size"]: r["n"] for r in groups.groupBy("size").agg(F.count("*").alias("n")).collect()}
    plan = choose(sizes, shares)
    edges_of = []  # per size the rank below which a group gets the split
    names = sorted(shares)
    for size in sizes:
        upto = 0
        for name in names:
            n = plan[name].get(size, 0)
            if n:
                edges_of.append((size, upto, upto + n, name))
                upto += n
    from pyspark.sql import Window as W

    per = groups.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = per.withColumn("before", F.sum("n").over(W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).select("size", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("size", "bucket").orderBy("h", "group_id")) - 1
    ranked = groups.withColumn("inside", inside).join(before, ["size", "bucket"]).withColumn("rank", F.col("inside") + F.col("before"))
    steps = docs.sparkSession.createDataFrame(edges_of, "size long, lo long, hi long, split string")
    chosen = ranked.join(F.broadcast(steps), "size").where("rank >= lo and rank < hi").select("group_id", "split")
    return member.join(chosen, "group_id").select("doc_id", "group_id", "split")


def torn_groups(docs: DataFrame, key: str = "tm", split: str = "split") -> DataFrame:
    """Positive values of ``key`` whose records stand in more than one present split.

    Components are those of :func:`hook_and_shortcut`; a component is torn if the smallest and
    the largest split name of its records differ. Null splits are ignored.
    """
    used = docs.where((F.col(key) > 0) & F.col("doc_id").isNotNull())
    roots = hook_and_shortcut(used.select(F.col("doc_id").alias("record"), F.col(key).alias("key")))
    stands = docs.select(F.col("doc_id").alias("record"), read_split(split).alias("split")).where("split <> ''").distinct()
    torn = roots.join(stands, "record").groupBy("root").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select("root")
    members = roots.join(torn, "root", "left_semi").select(F.col("record").alias("doc_id"))
    return used.select("doc_id", key).join(members, "doc_id", "left_semi").select(key).distinct()
