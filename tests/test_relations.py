import random

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from stemma.config import SHARES
from stemma.operators import grouping, joins, ranking, tasks
from stemma.streaming import stateless

from .conftest import rows


def test_first_match(spark):
    docs = spark.createDataFrame([("d1", ["x", "b", "a"]), ("d2", ["x"]), ("d3", []), ("d4", None), ("d5", ["a", "a"])], "doc_id string, hgv array<string>")
    dates = spark.createDataFrame([("a", 1, 2), ("b", 3, 4), ("b", 3, 4), ("c", 5, None), (None, 1, 1)], "hgv_id string, date_lo int, date_hi int")
    got = joins.first_match(docs, joins.one_date_per_id(dates), "hgv", "hgv_id", ["date_lo", "date_hi"])
    assert rows(got) == [("d1", 3, 4), ("d2", None, None), ("d3", None, None), ("d4", None, None), ("d5", 1, 2)]


def test_labels(spark):
    t = spark.createDataFrame([("h/k%3B1", "A", "x"), ("h/k;1/", "A", "x"), ("h/k2", "A", "x"), ("h/k2", "A", "y"), ("h/k3", "A", None), ("h/k3 ", "A", None), (None, "A", "x")], "papyri_info string, gram_type string, gram_subtype string")
    labels = joins.labels_by_url(t)
    assert rows(labels) == [("k3", "A", None), ("k;1", "A", "x")]
    docs = spark.createDataFrame([("a", "ddbdp", "k;1"), ("b", "dclp", "k;1"), ("c", "ddbdp", "k2"), ("d", "ddbdp", None)], "doc_id string, source string, hybrid string")
    assert rows(joins.with_labels(docs, labels)) == [("a", "A", "x"), ("b", None, None), ("c", None, None), ("d", None, None)]


def test_key_in_both(spark):
    docs = spark.createDataFrame([("a", "ddbdp", 1), ("b", "dclp", 1), ("c", "ddbdp", None), ("d", "dclp", None), ("e", "dclp", 2)], "doc_id string, source string, tm long")
    assert rows(joins.key_in_both(docs)) == [("a", True), ("b", True), ("c", False), ("d", False), ("e", False)]


def union_find(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def random_edges(seed):
    r = random.Random(seed)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    r.shuffle(edges)
    return edges


def test_components(spark):
    edges = random_edges(1)
    got = grouping.components(spark.createDataFrame([*edges, (5, None), (7, 7), edges[0]], "a long, b long"))
    assert dict(rows(got)) == {k: v for k, v in union_find([e for e in edges if e[0] != e[1]]).items()}
    assert rows(grouping.components(spark.createDataFrame([], "a long, b long"))) == []


def test_minhash(spark):
    r = random.Random(2)
    text = ["".join(r.choice("αβγδεζηθ") for _ in range(400)) for _ in range(20)]
    docs = [Row(doc_id=f"a{i:02}", lines=[t[:200], t[200:]]) for i, t in enumerate(text)]
    docs += [Row(doc_id=f"b{i:02}", lines=[t]) for i, t in enumerate(text[:5])]
    docs += [Row(doc_id=f"c{i:02}", lines=[t[:395] + "ωωωωω"]) for i, t in enumerate(text[:5])]
    docs += [Row(doc_id="short", lines=["αβ"]), Row(doc_id="none", lines=None), Row(doc_id="empty", lines=[])]
    got = union_find(rows(grouping.minhash_pairs(spark.createDataFrame(docs, "doc_id string, lines array<string>"))))
    assert got == {f"{k}{i:02}": f"a{i:02}" for i in range(5) for k in "abc"}


def test_bands():
    assert grouping._bands(0.8, 128) == (9, 13)


def test_grouped_splits_and_folds(spark):
    docs = spark.createDataFrame([(f"d{i:03}", i % 50 if i < 200 else None, "AB"[i % 3 == 0]) for i in range(300)], "doc_id string, tm long, label string")
    g = grouping.grouped_splits(docs, grouping.number_edges(docs), SHARES)
    assert g.count() == 300 and g.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    again = grouping.grouped_splits(docs.repartition(7), grouping.number_edges(docs.repartition(1)), SHARES)
    assert rows(g) == rows(again)
    joined = docs.join(g, "doc_id")
    folds = grouping.stratified_folds(joined)
    assert folds.count() == joined.select("group_id").distinct().count() == folds.select("group_id").distinct().count()
    per = joined.join(folds, "group_id").groupBy("fold", "label").count().collect()
    for lab, n in (("A", 200), ("B", 100)):
        assert all(0.6 * n / 5 < r["count"] < 1.4 * n / 5 for r in per if r["label"] == lab), per


def test_folds_spread_rare_labels(spark):
    docs = [(f"{lab}s{i}", f"L{lab:02}") for lab in range(40) for i in range(10)]
    docs += [(f"{lab}p{i}", f"L{lab:02}") for lab in range(40) for i in range(5) for _ in range(3)]
    df = spark.createDataFrame(docs, "group_id string, label string")
    folds = grouping.stratified_folds(df)
    per = {(r["label"], r["fold"]): r["count"] for r in df.join(folds, "group_id").groupBy("label", "fold").count().collect()}
    assert per == {(f"L{lab:02}", f): 5 for lab in range(40) for f in range(5)}
    assert rows(folds) == rows(grouping.stratified_folds(df.repartition(7)))


def test_tasks(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c"), ("b", None)], "y string, pred string")
    assert abs(tasks.macro_f1(p, []).first()[0] - (2 / 3 + 0 + 0) / 3) < 1e-12
    weighted = spark.createDataFrame([("a", "a", 1.0), ("b", "b", 0.0)], "y string, pred string, w double")
    assert tasks.macro_f1(weighted, [], weight="w").first()[0] == 0.5
    assert tasks.mae(spark.createDataFrame([(1.0, 3.0, 1.0), (1.0, 1.0, 3.0)], "y double, pred double, w double"), [], weight="w").first()[0] == 0.5
    assert tasks.mae(spark.createDataFrame([(1.0, 3.0, 0.0)], "y double, pred double, w double"), [], weight="w").first()[0] is None
    assert tasks.majority(spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "y string")).first()[0] == "a"
    docs = spark.createDataFrame([("a", ["αβ▯", "", "α"]), ("b", []), ("c", None)], "doc_id string, lines array<string>")
    lengths = np.array([2, 0, 1])
    got = {r["doc_id"]: tuple(r)[1:] for r in tasks.line_features(docs).collect()}
    assert np.allclose(got["a"], [3, lengths.mean(), lengths.std(), 0, 2, 1, *np.percentile(lengths, [25, 75])])
    assert got["b"] == got["c"] == (1, 0.0, 0.0, 0, 0, 0.0, 0.0, 0.0)


def test_samples_and_ranks(spark):
    d = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("split"), (F.col("id") * 7919 % 500).alias("x"))
    s = tasks.sample_per_group(d, 30)
    assert s.groupBy("split").count().where("count <> 30").count() == 0
    assert rows(s, "doc_id") == rows(tasks.sample_per_group(d.repartition(5), 30), "doc_id")
    assert rows(ranking.dense_index(d, ["x"]), "x", "index") == sorted([(i, i) for i in range(500)], key=repr)
    top = ranking.top_per_group(d, ["split"], [F.desc("x")], 3)
    assert rows(top, "split", "rank", "x") == [(0, 1, 498), (0, 2, 496), (0, 3, 494), (1, 1, 499), (1, 2, 497), (1, 3, 495)]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Ἄλφα ΒΗΤΑ"), (2, None)], "id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    q = stateless.split(stateless.normalized(stream), "id").writeStream.format("memory").queryName("stream_out").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("stream_out"), "id", "normal", "letters") == [(1, "αλφα βητα", 8), (2, None, None)]
