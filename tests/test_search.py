import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.functions.distance import best_match
from stemma.operators import models, search, stats
from stemma.plans import pipeline

from .conftest import rows


@pytest.fixture(scope="module")
def units(spark):
    r = random.Random(3)
    texts = ["\n".join("".join(r.choice("αβγδ▯") for _ in range(r.randrange(0, 15))) for _ in range(3)) for _ in range(60)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(60, ""), (61, None)], "unit_id long, text string").cache()


@pytest.fixture(scope="module")
def queries(spark, units):
    return spark.createDataFrame([("αβ",), ("αβγ",), ("γδαβ",), ("ααββγγδδ",), ("αβγδ" * 20,), ("ω",), ("αβγ",), (None,), ("",)], "query string").cache()


def test_distance_methods(spark, units, queries):
    text = {u: t or "" for u, t in rows(units)}
    qs = sorted({q for q, in rows(queries) if q})
    d = {(q, u): best_match(q, t) for q in qs for u, t in text.items()}
    hits, ranked = search.run_methods(units, queries, methods=("exact", "lev1", "lev2", "normdist", "minedit"), top=10)
    got = {}
    for m, q, u in rows(hits, "method", "query", "unit_id"):
        got.setdefault(m, set()).add((q, u))
    assert got["exact"] == {x for x, v in d.items() if v == 0} == {(q, u) for q in qs for u, t in text.items() if q in t}
    assert got["lev1"] == {x for x, v in d.items() if v <= 1} and got["lev2"] == {x for x, v in d.items() if v <= 2}
    assert got["normdist"] == {x for x, v in d.items() if v / len(x[0]) <= 0.25}
    order = {}
    for m, q, u, r in rows(ranked, "method", "query", "unit_id", "rank"):
        order.setdefault((m, q), {})[r] = u
    for q in qs:
        best = sorted(text, key=lambda u: (d[q, u], u))[:10]
        assert [u for _, u in sorted(order.get(("minedit", q), {}).items())] == [u for u in best if d[q, u] < len(q)]
        assert [u for _, u in sorted(order.get(("normdist", q), {}).items())] == [u for u in best if d[q, u] / len(q) <= 0.25]
    assert set(rows(search.relevance(units, queries))) == got["exact"]


def grams(t, n):
    return [s[i : i + n] for s in t.replace("\n", "▯").split("▯") for i in range(len(s) - n + 1)]


def test_vector_methods(spark, units, queries):
    text = {u: t or "" for u, t in rows(units)}
    train = {u: t for u, t in text.items() if u % 2}
    t_df = units.where("unit_id % 2 = 1")
    qs = sorted({q for q, in rows(queries) if q})
    df = {}
    for t in train.values():
        for g in {g for n in (2, 3, 4) for g in grams(t, n)}:
            df[g] = df.get(g, 0) + 1
    w = lambda t: {g: c * (math.log((1 + len(train)) / (1 + df[g])) + 1) for g in df if (c := [x for n in (2, 3, 4) for x in grams(t, n)].count(g))}
    got = {(q, u): s for q, u, s in rows(search.tfidf_scores(t_df, units, queries))}
    for q in qs[:3]:
        a = w(q)
        for u, t in list(text.items())[:20]:
            b = w(t)
            dot = sum(a[g] * b[g] for g in a if g in b)
            want = dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if dot else 0
            assert abs(got.get((q, u), 0) - want) < 1e-9
    df6 = {}
    for t in train.values():
        for g in set(grams(t, 6)):
            df6[g] = df6.get(g, 0) + 1
    got = {(q, u): s for q, u, s in rows(search.bm25_scores(t_df, units, queries))}
    for q in qs:
        for u, t in text.items():
            want = sum(math.log((len(train) - df6[g] + 0.5) / (df6[g] + 0.5) + 1) * (tf := grams(t, 6).count(g)) * 1.3 / (tf + 0.3) for g in grams(q, 6) if g in df6)
            assert abs(got.get((q, u), 0) - want) < 1e-9
    share = {(q, u): s for q, u, s in rows(search.trigram_share(units, queries))}
    assert share == {(q, u): s for q in qs for u, t in text.items() if (g := set(grams(q, 3))) and (s := len(g & set(grams(t, 3))) / len(g))}


def test_all_and_wrong_methods(spark, units, queries):
    with pytest.raises(ValueError):
        search.run_methods(units, queries)
    with pytest.raises(ValueError):
        search.run_methods(units, queries, units, methods=("x",))
    hits, ranked = search.run_methods(units, queries, units)
    m = {r["method"]: r for r in search.metrics(hits, ranked, search.relevance(units, queries)).collect()}
    assert set(m) == set(search.METHODS) and m["exact"]["filter_f1"] == 1.0 and m["bm25"]["filter_p"] is None and m["exact"]["recall20"] is None


def test_metrics(spark):
    hits = spark.createDataFrame([("exact", "q", 1), ("exact", "q", 99)], "method string, query string, unit_id long")
    ranked = spark.createDataFrame([("bm25", "q", u, r) for r, u in enumerate([50, 1, 2, 60], 1)] + [("bm25", "norel", 1, 1)], "method string, query string, unit_id long, rank int")
    rel = spark.createDataFrame([("q", u) for u in range(25)] + [("unranked", 1)], "query string, unit_id long")
    m = {r["method"]: r for r in search.metrics(hits, ranked, rel, ("exact", "bm25")).collect()}
    assert m["exact"]["filter_p"] == 0.5 and abs(m["exact"]["filter_r"] - 1 / 26) < 1e-12
    b = m["bm25"]
    assert (b["n_ranked"], b["recall20"], b["mrr"]) == (1, 2 / 20, 0.5)
    ideal = sum(1 / math.log2(i + 2) for i in range(10))
    assert abs(b["ndcg10"] - (1 / math.log2(3) + 1 / math.log2(4)) / ideal) < 1e-12


def test_query_sets(spark, units):
    forms = spark.createDataFrame([(1, "αβγδ"), (2, "αβγδ"), (3, "ββββ")], "doc_id int, form string")
    words = spark.createDataFrame([("αβγδοσ, x",), ("ζζζζζ, y",)], "value string")
    train = spark.createDataFrame([(1, "ααβγδα")], "unit_id long, text string")
    q = search.build_queries(units, forms, words, train, n_synthetic=5)
    text = [t or "" for _, t in rows(units)]
    assert all(any(x in t for t in text) for _, x in rows(q))
    per = dict(rows(q.where("set = 'synthetic'").groupBy(F.length("query").alias("n")).count()))
    assert per[3] == 5 and set(per) <= set(range(3, 13))
    assert rows(search.name_queries(forms)) == [("αβγδ",)] and rows(search.headword_queries(words, train)) == [("αβγδ",)]


def test_thresholds(spark):
    t = lambda *v: tuple(stats.thresholds(spark.createDataFrame([(float(i), x) for i, x in enumerate(v)], "cer double, ret_lo double")).first())
    assert t(1.0, 0.97, 0.94, 0.99) == (1.0, 2.0 + 1.0)
    assert t(0.5, 1.0) == (None, None)
    assert t(1.0, float("nan"), 1.0) == (0.0, 0.0)
    assert t(1.0, None, 1.0) == (0.0, 0.0)


def test_curve(spark):
    r = random.Random(5)
    data = [(float(c), s, f"u{u}", "ab"[u % 2], "ab"[u % 2] if r.random() > c / 100 else r.choice(["a", "b", None])) for c in (0, 10, 50) for s in (1, 2) for u in range(30)]
    p = spark.createDataFrame(data, "cer double, seed int, unit string, y string, pred string")
    got = {x["cer"]: x for x in stats.curve(p, "genre", 60).collect()}
    again = {x["cer"]: x for x in stats.curve(p.repartition(7), "genre", 60).collect()}
    assert got == again and got[0.0]["point"] == 1.0 and got[0.0]["ret_lo"] == 1.0 and got[50.0]["lo"] <= got[50.0]["point"] <= got[50.0]["hi"] and got[10.0]["n"] == 60

    def f1(c):
        x = [(y, z) for cc, _, _, y, z in data if cc == c]
        labels = {v for a in x for v in a if v}
        return np.mean([2 * sum(y == z == v for y, z in x) / sum((y == v) + (z == v) for y, z in x) for v in labels])

    assert all(abs(got[c]["point"] - f1(c)) < 1e-12 for c in got)
    years = p.select("cer", "seed", "unit", F.lit(10.0).alias("y"), (F.lit(12.0) + F.col("cer")).alias("pred"))
    d = {x["cer"]: x for x in stats.curve(years, "dating", 20).collect()}
    assert d[10.0]["point"] == 12.0 and abs(d[10.0]["ret"] - 2 / 12) < 1e-12 and abs(d[10.0]["ret_lo"] - 2 / 12) < 1e-12


def test_by_size(spark):
    p = spark.createDataFrame([(float(c), 1, f"u{u}", "a", "a", 10 if u < 40 else 5000) for c in (0, 10) for u in range(50)], "cer double, seed int, unit string, y string, pred string, letters int")
    got = stats.by_size(p, "genre", 20)
    assert rows(got, "bin", "cer", "n", "c95") == [("1–19", 0.0, 40, 10.0), ("1–19", 10.0, 40, 10.0)]
    wide = stats.by_size_wide(got, [0, 10]).first()
    assert (wide["n"], wide["m0"], wide["m10"]) == (40, 1.0, 1.0)


def test_models(spark):
    docs = spark.createDataFrame([(f"d{i}", ["αβγαβγ" if i % 2 else "δεζδεζ", "α"] * (1 + i % 2), 10, "xy"[i % 2], 100.0 * (i % 2)) for i in range(40)], "doc_id string, lines array<string>, letters int, y string, z double")
    for name, options in (("tfidf", {"iterations": 20}), ("linelen", {"trees": 3}), ("letterbag", {"iterations": 20})):
        got = models.build(name, "genre", **options).fit(docs).predict(docs)
        assert got.where("y <> pred").count() == 0, name
    dated = docs.drop("y").withColumnRenamed("z", "y")
    for name in ("tfidf", "letterbag"):
        got = models.build(name, "dating", iterations=30).fit(dated).predict(dated)
        assert got.where("abs(y - pred) > 30").count() == 0, name
    for bad in ("charcnn", "byt5", "x"):
        with pytest.raises(ValueError):
            models.build(bad, "genre")


def test_tfidf_keeps_every_ngram(spark):
    r = random.Random(5)
    texts = ["".join(r.choices("αβγδεζηθικλμνξοπρστυφχψωϛϙϡ", k=80_000)) for _ in range(2)]
    docs = spark.createDataFrame([(f"d{i}", [texts[i % 2]], 80_000, "xy"[i % 2]) for i in range(4)] + [("none", [], 0, "x")], "doc_id string, lines array<string>, letters int, y string")
    df = {}
    for t in texts:
        for g in {t[i : i + n] for n in range(1, 6) for i in range(len(t) - n + 1)}:
            df[g] = df.get(g, 0) + 2
    assert len(df) > 1 << 18
    model = models.TfidfModel("genre", iterations=1).fit(docs)
    assert model.size == model.head.numFeatures == len(df)
    known = {t: (i, w) for t, i, w in rows(model.vocabulary, "term", "index", "idf")}
    assert sorted(i for i, _ in known.values()) == list(range(len(df)))
    probe = "αβγααβω"
    tf = {}
    for g in (probe[i : i + n] for n in range(1, 6) for i in range(len(probe) - n + 1)):
        tf[g] = tf.get(g, 0) + 1
    want = {known[g][0]: (1 + math.log(c)) * (math.log(6 / (1 + df[g])) + 1) for g, c in tf.items() if g in df}
    norm = math.sqrt(sum(w * w for w in want.values()))
    got = {x["doc_id"]: x["features"] for x in model.features(spark.createDataFrame([("p", [probe]), ("none", [])], "doc_id string, lines array<string>")).collect()}
    assert got["p"].indices.tolist() == sorted(want) and np.allclose(got["p"].values, [want[i] / norm for i in sorted(want)])
    assert got["none"].numNonzeros() == 0


def test_letterbag_is_sparks_softmax(spark, monkeypatch):
    """Hashes, weights and steps are those of HashingTF and LogisticRegression, with blocks in memory and in files."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, Normalizer, StringIndexer

    r = random.Random(8)
    texts = ["".join(r.choice("αβγδ▯x€" + "εζη"[i % 3] * 2) for _ in range(r.randrange(0, 60))) for i in range(90)]
    docs = spark.createDataFrame([(f"d{i}", [t], 10, "xyz"[i % 3]) for i, t in enumerate(texts)] + [("none", [], 0, "x")], "doc_id string, lines array<string>, letters int, y string")
    buckets = 3000
    terms = docs.withColumn("terms", models.char_ngrams(F.array_join("lines", "\n"), (1, 5)))
    x = Normalizer(inputCol="tf", outputCol="features", p=1.0).transform(HashingTF(inputCol="terms", outputCol="tf", numFeatures=buckets).transform(terms))
    x = StringIndexer(inputCol="y", outputCol="label", stringOrderType="alphabetAsc").fit(x).transform(x)
    for n in (3, 100):
        head = LogisticRegression(maxIter=n, regParam=1e-6, standardization=False, family="multinomial").fit(x)
        want = {z["doc_id"]: z["probability"].toArray() for z in head.transform(x).collect()}
        for block, held in ((1 << 20, 1 << 30), (200, 0)):
            monkeypatch.setattr(models.letterbag, "BLOCK", block)
            monkeypatch.setattr(models.letterbag, "HELD", held)
            labels, weights, intercept = models.letterbag.fitted(zip([*texts, ""], [*("xyz"[i % 3] for i in range(90)), "x"]), (1, 5), buckets, n)
            got = models.letterbag.probabilities(models.letterbag.margins(models.letterbag.packed([*texts, ""], (1, 5), buckets, fit=False), weights) + intercept)
            off = max(abs(g - want[d]).max() for g, d in zip(got, [*(f"d{i}" for i in range(90)), "none"]))
            assert labels == ["x", "y", "z"] and off < 1e-6, (n, block, off)


def test_folds_are_fitted_side_by_side(spark):
    """One job fits the letter bags of all folds, each from the documents outside its fold."""
    docs = spark.createDataFrame([(f"d{i}", ["αβγαβγ" if i % 2 else "δεζδεζ"], 10, "xy"[i % 2], i % 10 // 2) for i in range(60)], "doc_id string, lines array<string>, letters int, gram_type string, fold int")
    got = pipeline.experiment(docs, "form", "letterbag", cers=(0,), seeds=(1,), iterations=20)
    assert len(rows(got, "unit")) == 60 and got.where("y <> pred").count() == 0
    apart = docs.withColumn("y", F.col("gram_type")).withColumn("_model", F.col("fold"))
    several = models.build("letterbag", "form", iterations=20).fit_each(apart, 5)
    one = models.build("letterbag", "form", iterations=20).fit(apart.where("fold = 3").drop("_model"))
    assert np.array_equal(several[3].head[0], one.head[0]) and several[3].labels == one.labels == ["x", "y"]
