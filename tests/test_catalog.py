"""A few catalogue queries against their SQL; compare.py runs all of them."""

import hashlib
import os
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from compare import plain
from stemma.plans import pipeline

SF = "/root/testdata/sf0.001"
QUICK = ("corpus_report", "normalize_text", "letter_counts", "line_stats", "first_match_dates", "labelled_documents", "number_groups", "baseline_form", "lost_lines", "p6_found")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", QUICK)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    got = sorted((tuple(plain(v) for v in r) for r in df.select(cols).toPandas().astype(object).values.tolist()), key=repr)
    assert got == sorted((tuple(plain(v) for v in r) for r in want.df()[cols].astype(object).values.tolist()), key=repr)


def test_every_query_is_named():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_searches_have_the_full_sets(spark):
    q = entry.queries()
    sets = [tuple(r) for r in q["query_sets"](spark, SF).collect()]
    count = {s: sum(x == s for x, _ in sets) for s in {s for s, _ in sets}}
    assert {"synthetic", "names", "headwords"} <= set(count) and count["synthetic"] == 1000, count  # no formula stands in these tables
    full = {r["query"] for r in q["search_queries"](spark, SF).collect()}
    assert full == {x for _, x in sets}
    given = spark.read.parquet(f"{SF}/corpus.parquet").where("doc_id is not null").select("doc_id", "lines", "split").collect()
    texts = {r["doc_id"]: "\n".join(r["lines"] or []) for r in given if (r["split"] or "").strip(" \t").lower() == "test"}
    want = {(x, d) for d, t in texts.items() for x in full if x in t}
    assert {tuple(r) for r in q["search_relevance"](spark, SF).collect()} == want
    near = {(r["query"], r["unit_id"]) for r in q["search_distances"](spark, SF).where("method = 'lev1'").collect()}
    assert want <= near and {x for x, _ in near} == full


def brute_curve(preds, g, boots):
    """cer -> (point, lo, ret_lo) of a classifier, each replicate drawn by hand."""
    def draws(kind, members, b):
        at = lambda j: int(hashlib.sha256(f"20260913|{g}|{kind}|{b}|{j}".encode()).hexdigest()[:16], 16) / 2**64
        return [members[int(at(j) * len(members))] for j in range(len(members))]

    def f1(cer, weight):
        tp, n, labels = {}, {}, set()
        for c, seed, unit, y, pred in preds:
            if c == cer:
                w = weight(unit, seed)
                labels |= {y, pred}
                for x in (y, pred):
                    n[x] = n.get(x, 0) + w
                tp[y] = tp.get(y, 0) + w * (y == pred)
        return sum(2 * tp.get(x, 0) / n[x] for x in labels if n.get(x)) / len(labels)

    units, seeds, cers = (sorted({p[i] for p in preds}) for i in (2, 1, 0))
    scores = {c: [] for c in cers}
    for b in range(boots):
        u, e = draws("unit", units, b), draws("seed", seeds, b)
        for c in cers:
            scores[c].append(f1(c, lambda x, y: u.count(x) * e.count(y)))  # noqa: B023
    ret = {c: [x / y for x, y in zip(scores[c], scores[cers[0]]) if y] for c in cers}
    return {c: (f1(c, lambda *_: 1), np.percentile(scores[c], 2.5), np.percentile(ret[c], 2.5)) for c in cers}


def test_full_curves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("stemma.operators.stats.DRAWS", 5)
    r = random.Random(7)
    preds = [(c, s, f"u{u:02}", y := "ab"[u % 2], y if r.random() > c / 20 else "ab"[1 - u % 2]) for c in (0.0, 2.0, 8.0) for s in (1, 2) for u in range(16)]
    spark.createDataFrame([(*p, 10) for p in preds], "cer double, seed int, unit string, y string, pred string, letters int").write.parquet(str(tmp_path / "predictions.parquet"))
    q = entry.queries()
    want = brute_curve(preds, "", 1000)
    got = {x["cer"]: x for x in q["bootstrap_curve"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for c, (point, lo, ret_lo) in want.items():
        assert np.allclose([got[c]["point"], got[c]["lo"], got[c]["ret_lo"]], [point, lo, ret_lo], atol=1e-8), c
    limits = tuple(max((c for c in want if all(want[x][2] >= least for x in want if x <= c)), default=None) for least in (0.95, 0.9))
    assert tuple(q["curve_thresholds"](spark, str(tmp_path)).first()) == limits
    sized = {x["cer"]: x["ret_lo"] for x in q["curve_by_size"](spark, str(tmp_path)).collect()}
    assert np.allclose([sized[c] for c in sorted(sized)], [x[2] for _, x in sorted(brute_curve(preds, "1–19", 200).items())], atol=1e-8)


def test_models_run_in_full(monkeypatch):
    seen = {}
    monkeypatch.setattr(pipeline, "experiment", lambda docs, *a, cers, seeds, **options: seen.update(options))
    monkeypatch.setattr("stemma.plans.catalog._docs", lambda spark, sf: None)
    for name in ("model_genre", "model_dating", "model_linelen", "model_form", "model_matched"):
        entry.queries()[name](None, "")
    assert seen == {}
