import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.llm import groups, sampling, splits

from ..conftest import rows
from ..test_relations import random_edges, union_find


@pytest.mark.parametrize("seed", [1, 2])
def test_hash_to_min(spark, seed):
    edges = random_edges(seed)
    got = groups.hash_to_min(spark.createDataFrame([*edges, (5, None), (None, 5), (7, 7), *edges[:9]], "a long, b long"))
    assert dict(rows(got)) == union_find([e for e in edges if e[0] != e[1]])


def test_hash_to_min_shapes(spark):
    star = [("hub", f"x{i}") for i in range(3000)]
    path = [(f"p{i:03}", f"p{i + 1:03}") for i in range(130)]
    got = dict(rows(groups.hash_to_min(spark.createDataFrame(star + path, "a string, b string"))))
    assert {got[f"x{i}"] for i in range(3000)} == {"hub"} and {got[f"p{i:03}"] for i in range(131)} == {"p000"}
    assert rows(groups.hash_to_min(spark.createDataFrame([], "a string, b string"))) == []


def test_match_groups(spark):
    records = spark.createDataFrame(
        [("a", 1), ("b", 1), ("c", None), ("d", 0), ("e", 0), ("f", -1), ("g", -1), ("h", 7), ("i", 9), ("j", None), (None, 1), ("a", 1), ("k", 11), ("l", 12)], "doc_id string, tm long"
    ).withColumns({"left_id": F.lit("clash"), "lo": F.lit(1), "score": F.lit(1.0)})
    m = [(" B.XML", "c", 0.8), ("d", "e", 0.79), ("d", "f", None), ("g", "e", float("nan")), ("h", "h", 1.0), ("i", "nobody", 1.0), (None, "j", 1.0), ("C", "b", 0.9), ("k", "l.xml ", 1.0), ("k", "l.xml ", 1.0), ("l", "k", 0.1)]
    matches = spark.createDataFrame(m, "left_id string, right_id string, score double").withColumn("doc_id", F.lit(5))
    want = [("a", "a"), ("b", "a"), ("c", "a"), ("k", "k"), ("l", "k")]
    assert rows(groups.match_groups(records, matches)) == want
    assert rows(groups.match_groups(records.repartition(7), matches.repartition(5))) == want
    assert rows(groups.match_groups(records.limit(0), matches)) == []
    assert rows(groups.match_groups(records, matches.limit(0))) == [("a", "a"), ("b", "a")]


def test_hooking(spark):
    r = random.Random(3)
    edges = [(f"r{r.randrange(80):02}", f"k{r.randrange(60):02}") for _ in range(70)] + [(f"chain{i:02}", f"c{i + j}") for i in range(40) for j in (0, 1)]
    got = dict(rows(splits.hook_and_shortcut(spark.createDataFrame([*edges, (None, "k"), ("solo", None), edges[0]], "record string, key string"))))
    want = union_find([(a, "~" + b) for a, b in edges])
    assert got == {k: v for k, v in want.items() if not k.startswith("~")}
    assert rows(splits.hook_and_shortcut(spark.createDataFrame([], "record string, key string"))) == []


def test_subset_sum():
    r = random.Random(4)
    for _ in range(150):
        sizes = {r.randrange(1, 12): r.randrange(0, 5) for _ in range(r.randrange(1, 5))}
        target = r.randrange(0, 40)
        sums = {0}
        for s, n in sizes.items():
            sums = {t + s * k for t in sums for k in range(n + 1)}
        taken = splits.subset_sum(sizes, target)
        assert all(0 < n <= sizes[s] for s, n in taken.items())
        got = sum(s * n for s, n in taken.items())
        assert abs(got - target) == min(abs(t - target) for t in sums), (sizes, target)


def test_subset_sum_at_every_size():
    r = random.Random(5)
    for _ in range(40):
        sizes = {r.randrange(2, 40): r.randrange(1, 6) for _ in range(r.randrange(1, 6))}
        target = r.randrange(1, sum(s * n for s, n in sizes.items()))
        large = splits.subset_sum({s * 10**6: n for s, n in sizes.items()}, target * 10**6)
        assert large == {s * 10**6: n for s, n in splits.subset_sum(sizes, target).items()}, (sizes, target)
    for _ in range(40):
        sizes = {r.randrange(1, 2_000_000): r.randrange(1, 4) for _ in range(r.randrange(1, 6))} | {1: r.randrange(0, 3), 7: r.randrange(0, 3)}
        whole = sum(s * n for s, n in sizes.items())
        target = r.choice([whole // 10, whole // 3, r.randrange(1, whole)])
        sums = {0}
        for s, n in sizes.items():
            sums = {t + s * k for t in sums for k in range(n + 1)}
        taken = splits.subset_sum(sizes, target)
        assert all(0 < n <= sizes[s] for s, n in taken.items())
        assert sum(s * n for s, n in taken.items()) == min(sums, key=lambda t: (abs(t - target), t)), (sizes, target)
    assert splits.subset_sum({2_000_000: 1, 3_000_000: 1, 5_000_000: 1, 7: 2}, 5_000_007) in ({5_000_000: 1, 7: 1}, {2_000_000: 1, 3_000_000: 1, 7: 1})


def test_subset_sum_of_many_records():
    began = time.time()
    sizes = {s: max(1, 10**9 // (3 * s**2)) for s in range(1, 30_000)} | {2_000_000: 3, 90_000_000: 2}
    n = sum(s * k for s, k in sizes.items())
    plan = splits.choose(sizes, splits.SHARES)
    for name, share in splits.SHARES.items():
        assert abs(sum(s * k for s, k in plan[name].items()) - share * n) <= 1
        assert all(0 <= k for k in plan[name].values())
    assert all(sum(p.get(s, 0) for p in plan.values()) == k for s, k in sizes.items())
    assert n > 10**9 and time.time() - began < 20


def test_grouped_split(spark):
    data = [(f"d{i:04}", None if i % 9 == 0 else (1 if i < 250 else i // 3), f"s{i // 7}" if i % 5 == 0 else None) for i in range(1000)]
    docs = spark.createDataFrame([*data, data[5], (None, 1, "s")], "doc_id string, author long, source string").withColumn("split", F.lit("old"))
    got = splits.grouped_split(docs, ["author", "source"])
    assert got.count() == 1000 and got.select("doc_id").distinct().count() == 1000
    for key in ("author", "source"):
        assert docs.drop("split").join(got, "doc_id").where(f"{key} is not null").groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    n = dict(rows(got.groupBy("split").count()))
    assert n == {"train": 800, "val": 100, "test": 100}
    assert rows(got) == rows(splits.grouped_split(docs.repartition(7), ["author", "source"]))
    assert rows(splits.grouped_split(docs.limit(0), ["author", "source"])) == []


def test_torn(spark):
    d = [("a", 1, " Train\t"), ("b", 1, "TRAIN"), ("c", 2, "val"), ("d", 2, "test "), ("e", 3, None), ("f", 3, "val"), ("g", 0, "val"), ("h", 0, "test"), ("i", None, "val"), ("j", -1, "val"), ("k", -1, "test"), ("c", 2, "val"), (None, 3, "test"), ("l", 4, " "), ("m", 4, "val")]
    docs = spark.createDataFrame(d, "doc_id string, tm long, split string").withColumns({"record": F.lit(1), "key": F.lit(2), "root": F.lit(3)})
    assert rows(splits.torn_groups(docs)) == [(2,)]
    assert rows(splits.torn_groups(docs.limit(0))) == []


def test_sample(spark):
    data = [(f"d{i:05}", [None, 0, -1, 5, i // 4][i % 5], f"2020-01-{i % 28 + 1:02}") for i in range(4000)]
    cols = "doc_id string, tm long, loaded_at string"
    old = spark.createDataFrame(data[:2500], cols)
    new = spark.createDataFrame(data + [(d, None if t else 77, "2021-01-01") for d, t, _ in data[::3]] + [(None, 1, None), data[0]], cols).withColumn("at", F.lit(0))
    a, b = set(rows(sampling.stable_sample(old, 0.2), "doc_id")), set(rows(sampling.stable_sample(new.repartition(7), 0.2), "doc_id"))
    assert a <= b and {d for d in b if d < ("d02500",)} == a and 0.15 < len(b) / 4000 < 0.42
    more = set(rows(sampling.stable_sample(new, 0.5), "doc_id"))
    assert b < more
    every = rows(sampling.stable_sample(new, 1.0))
    assert len(every) == 4000 and rows(sampling.stable_sample(new, 0.0)) == [] and rows(sampling.stable_sample(new.limit(0), 1.0)) == []
    tm = {}
    for d, t in every:
        if t and t > 0:
            tm.setdefault(t, set()).add((d,) in b)
    assert all(len(v) == 1 for v in tm.values())
    assert rows(sampling.stable_sample(old.drop("loaded_at"), 0.2), "doc_id") == sorted(a, key=repr)
