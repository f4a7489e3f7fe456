"""Pairwise matches consolidated into groups by hash-to-min."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stage

#: Sorts after every record id in code-point order, so that a key vertex is never a minimum.
KEY_MARK = "\U0010fffd"


def _fingerprint(s: DataFrame) -> tuple:
    h = F.xxhash64("lo", "hi")
    return tuple(s.agg(F.count("*"), F.expr("bit_xor(xxhash64(lo, hi))"), F.sum(h.bitwiseAND(F.lit(0x7FFFFFFF)))).first())


def hash_to_min(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """Connected components of the undirected links ``a``-``b``: one row (``vertex``, ``root``).

    Hash-to-min: each vertex holds a set of vertices, sends the whole set to its minimum and
    the minimum to all others, until nothing changes. After one round membership is symmetric,
    hence one table of pairs (lo, hi) with lo < hi holds all sets and the minimum of a vertex
    is ``min(lo)`` over the rows in which it is ``hi``: an aggregate with partial sums, never a
    window over one vertex, so that a vertex linked to a third of all rows costs no task more
    than others; the two look-ups of the minimum are joins against one row per vertex, which
    adaptive execution splits where a key is hot. Each round is written to the shared folder.

    Null ends, links of a vertex with itself and repeated links count for nothing; vertices
    without a link get no row; no links give no rows. Other columns of the input are ignored.
    Any orderable type serves as id; the root is the smallest vertex of the component.
    """
    stage = Stage(links.sparkSession, "h2m")
    s = stage.save(
        links.select(F.least(F.col(a), F.col(b)).alias("lo"), F.greatest(F.col(a), F.col(b)).alias("hi"), F.col(a).isNotNull().alias("u"), F.col(b).isNotNull().alias("v"))
        .where("u and v and lo <> hi").select("lo", "hi").distinct()
    )
    before = _fingerprint(s)
    for _ in range(max_rounds):
        if not before[0]:
            break
        low = s.groupBy("hi").agg(F.min("lo").alias("m"))
        both = s.join(low, "hi").join(low.select(F.col("hi").alias("lo"), F.col("m").alias("ml")), "lo", "left").withColumn("ml", F.coalesce("ml", "lo"))
        sent = both.select(F.explode(F.array(
            F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")),
            F.struct(F.col("m").alias("lo"), F.col("hi").alias("hi")),
            F.struct(F.col("ml").alias("lo"), F.col("hi").alias("hi")),
            F.struct(F.col("ml").alias("lo"), F.col("lo").alias("hi")),
        )).alias("p")).select("p.lo", "p.hi").where("lo <> hi").distinct()
        new = stage.save(sent)
        after = _fingerprint(new)
        stage.drop(s)
        s = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no stable state after {max_rounds} rounds")
    return s.select(F.col("hi").alias("vertex"), F.col("lo").alias("root")).union(s.select("lo", "lo").distinct())


def clean_id(c: Column | str) -> Column:
    """An id as the matchers write it: outer blanks, letter case and a final ``.xml`` don't count."""
    return F.regexp_replace(F.lower(F.trim(c if isinstance(c, Column) else F.col(c))), r"\.xml$", "")


def match_groups(records: DataFrame, matches: DataFrame, min_score: float = 0.8) -> DataFrame:
    """Every record that is linked with another: ``doc_id``, ``group_id`` (smallest id of its group).

    ``records`` has ``doc_id`` and ``tm``; ``matches`` has ``left_id``, ``right_id``, ``score``.
    Records are linked by a match of at least ``min_score`` (null and NaN don't count) whose two
    ids, cleaned, both exist, or by the same positive ``tm``. A number enters the graph as a
    vertex of its own, so that one number with a third of all records needs no join and no pairs.
    Null ids, repeated rows, unknown ids and self-matches are without effect; empty tables give
    no rows; further columns are ignored, whatever their names.
    """
    ids = records.select("doc_id").where("doc_id is not null").distinct()
    pairs = (
        matches.where((F.col("score") >= min_score) & ~F.isnan("score"))
        .select(clean_id("left_id").alias("x"), clean_id("right_id").alias("y"))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "x", "y")
        .where("x is not null and y is not null and a <> b").select("a", "b").distinct()
    )
    known = pairs.join(ids.withColumnRenamed("doc_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("doc_id", "b"), "b", "left_semi").select("a", "b")
    numbered = records.where("tm > 0 and doc_id is not null").select(F.col("doc_id").alias("a"), F.concat(F.lit(KEY_MARK), F.col("tm").cast("string")).alias("b"))
    found = hash_to_min(known.union(numbered))
    linked = found.where((F.col("vertex") != F.col("root")) & ~F.col("vertex").startswith(KEY_MARK)).select(F.col("vertex").alias("doc_id"), F.col("root").alias("group_id"))
    return linked.union(linked.select("group_id", "group_id").distinct())
