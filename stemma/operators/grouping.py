"""Grouping of a corpus by shared numbers and like texts, hashed splits, stratified folds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FOLDS, GAP, JACCARD, PERMUTATIONS, SEED, SHARES, SHINGLE
from ..functions import text as T
from ..session import Stage
from .ranking import dense_index


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """Connected components: ``vertex``, ``root`` (the smallest vertex), for every vertex with an edge to another.

    Alternating stars: in a large-star round each vertex links its larger neighbours to the
    smallest of its neighbourhood, in a small-star round the smaller ones; both are one
    aggregate and one join over the edges, whose number never grows. Null ends and loops are
    without effect.
    """
    stage = Stage(edges.sparkSession, "stars")
    e = stage.save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())

    def mark(df):
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(xxhash64(u, v) & 2147483647)")).first())

    before = mark(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        new = stage.save(small)
        after = mark(new)
        stage.drop(e)
        e = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no stable state after {max_rounds} rounds")
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def _bands(threshold: float, permutations: int, parts: int = 100) -> tuple[int, int]:
    """Bands and rows with the least sum of the areas of false candidates below and misses above the threshold."""
    s = (np.arange(parts) + 0.5) / parts
    best = None
    for rows in range(1, permutations + 1):
        for bands in range(1, permutations // rows + 1):
            p = 1 - (1 - s**rows) ** bands
            cost = p[s < threshold].sum() + (1 - p[s >= threshold]).sum()
            if best is None or cost < best[0]:
                best = (cost, bands, rows)
    return best[1], best[2]


def minhash_pairs(docs: DataFrame, lines: str = "lines", threshold: float = JACCARD, permutations: int = PERMUTATIONS, k: int = SHINGLE, seed: int = 1) -> DataFrame:
    """Pairs of documents whose MinHash signatures agree in at least ``threshold`` of their places: ``a``, ``b``.

    Candidates share a band of the signature; equal texts are compared once and then tied to
    the smallest id. Texts under ``k`` letters have no signature. An estimate: at a true similarity of 0.8
    a pair is found with a chance of about 0.4, at 0.95 nearly always. Signatures are made in
    Arrow batches; bands join on their hash, where adaptive execution splits a hot band.
    """
    bands, rows = _bands(threshold, permutations)
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 2**63, permutations, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**63, permutations, dtype=np.uint64)

    def sign(batches):
        for batch in batches:
            ids, texts = batch.column("rep"), batch.column("text").to_pylist()
            out = np.zeros((len(texts), permutations), np.uint32)
            for i, t in enumerate(texts):
                p = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                h = np.zeros(len(p) - k + 1, np.uint64)
                for j in range(k):
                    h = (h ^ p[j : len(p) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                low = np.full(permutations, np.uint64(2**64 - 1))
                for part in np.array_split(np.unique(h), len(h) // 4096 + 1):
                    low = np.minimum(low, (part[:, None] * mul + add).min(0))
                out[i] = low >> np.uint64(32)
            keys = [pa.array([bytes(out[i, b * rows : (b + 1) * rows].tobytes()) for i in range(len(texts))], pa.binary()) for b in range(bands)]
            full = pa.array([o.tobytes() for o in out], pa.binary())
            for b in range(bands):
                yield pa.record_batch([ids, pa.array([b] * len(texts), pa.int32()), keys[b], full], ["rep", "band", "key", "signature"])

    text = F.replace(F.array_join(lines, ""), F.lit(GAP), F.lit(""))
    stage = Stage(docs.sparkSession, "minhash")
    members = stage.save(docs.where("doc_id is not null").select("doc_id", text.alias("text")).where(F.length("text") >= k).distinct())
    reps = members.groupBy("text").agg(F.min("doc_id").alias("rep"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    banded = stage.save(reps.select("rep", "text").mapInArrow(sign, f"rep {kind}, band int, key binary, signature binary").withColumn("key", F.xxhash64("band", "key")))
    x, y = banded.select(F.col("rep").alias("a"), "key"), banded.select(F.col("rep").alias("b"), "key")
    pairs = x.join(y, "key").where("a < b").select("a", "b").distinct()
    signature = banded.where("band = 0").select("rep", "signature")
    need = int(np.ceil(threshold * permutations))

    def agree(batches):
        for batch in batches:
            s, t = ([np.frombuffer(v, np.uint32) for v in batch.column(c).to_pylist()] for c in ("s", "t"))
            keep = pa.array([bool((x == y).sum() >= need) for x, y in zip(s, t)])
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    signed = pairs.join(signature.toDF("a", "s"), "a").join(signature.toDF("b", "t"), "b")
    like = signed.select("a", "b", "s", "t").mapInArrow(agree, f"a {kind}, b {kind}")
    same = members.join(reps, "text").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    return like.union(same)


def number_edges(docs: DataFrame, key: str = "tm") -> DataFrame:
    """Each document tied to the smallest id that has the same positive number."""
    numbered = docs.where(F.col(key) > 0).select("doc_id", key).distinct()
    low = numbered.groupBy(key).agg(F.min("doc_id").alias("a"))
    return numbered.join(low, key).where("doc_id <> a").select("a", F.col("doc_id").alias("b"))


def grouped_splits(docs: DataFrame, edges: DataFrame, shares: dict[str, float] = SHARES, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``group_id``, ``split``: the components of ``edges``, split by the hash of the group's smallest id."""
    roots = components(edges)
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    g = ids.join(roots.withColumnRenamed("vertex", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id"))
    return g.withColumn("split", T.hash_split("group_id", shares, seed))


def stratified_folds(docs: DataFrame, group: str = "group_id", label: str = "label", folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """``group``, ``fold``: no group is in two folds, and each label is spread evenly.

    All groups are ranked by their leading label, size, count of every label and seeded hash, and dealt out
    in turns by that rank, whatever their number. Of groups that lead with a label and are alike in their counts
    two folds differ by one at most; of all documents in groups that lead with a label by the largest such group.
    """
    per = docs.where(F.col(group).isNotNull() & F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    counts = F.sort_array(F.collect_list(F.struct(label, "n"))).cast("string")
    lead = per.groupBy(group).agg(F.max_by(label, F.struct("n", label)).alias("_lead"), F.sum("n").alias("_size"), counts.alias("_counts"))
    lead = lead.withColumn("_h", F.xxhash64(F.lit(seed), group))
    ranked = dense_index(lead, [F.col("_lead"), F.desc("_size"), F.col("_counts"), F.col("_h"), F.col(group)], "_rank")
    return ranked.select(group, F.pmod("_rank", F.lit(folds)).cast("int").alias("fold"))
