"""The queries p1 to p10 over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import distinctive, encoding, groups, leakage, near, overlap, sampling, spans, splits

#: Folder of the public vocabularies; they are never copied.
TOKENIZERS = os.environ.get("STEMMA_TOKENIZERS", "/opt/tokenizers")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    corpus = table(spark, sf, "corpus").select("doc_id", "tm")
    found = groups.match_groups(corpus.union(table(spark, sf, "templates").select("doc_id", "tm")), table(spark, sf, "matches"))
    return found.join(corpus.select("doc_id").distinct(), "doc_id", "left_semi")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.torn_groups(table(spark, sf, "corpus").select("doc_id", "tm", "split"))


def p2_splits(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    return splits.grouped_split(table(spark, sf, "corpus").select("doc_id", "tm"), ["tm"], valid={"tm": F.col("tm") > 0})


def p2_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each split, and numbers that :func:`p2_splits` tears apart."""
    from pyspark.sql import functions as F

    got = p2_splits(spark, sf)
    numbers = table(spark, sf, "corpus").where("tm > 0").select("doc_id", "tm").distinct()
    placed = got.join(numbers, "doc_id").select("tm", "split").distinct()
    torn = placed.join(placed.groupBy("tm").count().where("count > 1"), "tm").groupBy("split").agg(F.count("*").alias("torn"))
    return got.groupBy("split").agg(F.count("*").alias("documents")).join(torn, "split", "left").select("split", "documents", F.coalesce("torn", F.lit(0)).cast("long").alias("torn"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    return overlap.cross_split_overlaps(table(spark, sf, "corpus")).select(F.least("train_id", "held_id").alias("doc_id_a"), F.greatest("train_id", "held_id").alias("doc_id_b"))


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    corpus = table(spark, sf, "corpus")
    return overlap.overlap_report(corpus, overlap.cross_split_overlaps(corpus)).select("split", "source", "pairs", "documents")


def p3_cover(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.split_coverage(table(spark, sf, "corpus"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return distinctive.distinctive_terms(table(spark, sf, "corpus"), min_count=3).where("df between 2 and 5").select("doc_id", "term")


def p4_scores(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    scored = distinctive.distinctive_terms(table(spark, sf, "corpus"), min_count=3)
    return scored.select("doc_id", "term", "tf", "df", "cf", F.round("ridf", 6).alias("ridf"), F.round("score", 6).alias("score"))


def p5_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stable_sample(table(spark, sf, "corpus"), 0.1)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_duplicate_groups(table(spark, sf, "corpus")).select("doc_id", "group_id")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, sf, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf, "documents"), table(spark, sf, "test_items")).where("run >= 48").select("doc_id", "item_id")


def p9_edited(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs whose best alignment scores at least as much as 48 equal letters, edited copies among them."""
    return leakage.leaked_items(table(spark, sf, "documents"), table(spark, sf, "test_items")).select("doc_id", "item_id", "score")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_splits, p2_totals, p3_found, p3_report, p3_cover, p4_found, p4_scores, p5_sample, p7_found, p8_ids, p9_found, p9_edited, p10_found)}

_TEXTS = """docs AS (SELECT DISTINCT doc_id, lower(trim(split, ' ' || chr(9))) AS split, replace(array_to_string(lines, ''), '▯', '') AS t FROM corpus),
 sh AS (SELECT DISTINCT doc_id, substr(t, i::BIGINT, 5) AS s FROM docs, LATERAL (SELECT unnest(range(1, length(t) - 3)) AS i) WHERE length(t) >= 20),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
 common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
 alike AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 5 * c >= 4 * (p.n + q.n - c))"""

SQL = {
    "p1_found": """WITH RECURSIVE ids AS (SELECT DISTINCT doc_id, tm FROM (SELECT doc_id, tm FROM corpus UNION ALL SELECT doc_id, tm FROM templates)),
 m AS (SELECT regexp_replace(lower(trim(left_id)), '\\.xml$', '') AS a, regexp_replace(lower(trim(right_id)), '\\.xml$', '') AS b FROM matches WHERE score >= 0.8 AND NOT isnan(score)),
 link AS (SELECT a, b FROM m WHERE a <> b AND a IN (SELECT doc_id FROM ids) AND b IN (SELECT doc_id FROM ids)
   UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY tm) FROM ids WHERE tm > 0),
 e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
 reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
 g AS (SELECT a AS doc_id, min(b) AS group_id, count(DISTINCT b) AS n FROM (SELECT a, b FROM reach UNION SELECT a, a FROM reach) GROUP BY 1)
SELECT doc_id, group_id FROM g WHERE n > 1 AND doc_id IN (SELECT doc_id FROM corpus)""",
    "p2_found": """SELECT tm FROM corpus WHERE tm > 0 GROUP BY tm HAVING count(DISTINCT lower(trim(split, ' ' || chr(9)))) > 1""",
    "p2_totals": """WITH n AS (SELECT count(DISTINCT doc_id) AS n FROM corpus)
SELECT 'val' AS split, round_even(0.1 * n, 0)::BIGINT AS documents, 0::BIGINT AS torn FROM n UNION ALL SELECT 'test', round_even(0.1 * n, 0)::BIGINT, 0 FROM n
UNION ALL SELECT 'train', n - 2 * round_even(0.1 * n, 0)::BIGINT, 0 FROM n""",
    "p3_found": f"""WITH {_TEXTS},
 s AS (SELECT doc_id, split FROM docs)
SELECT a AS doc_id_a, b AS doc_id_b FROM alike JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
WHERE (x.split = 'train' AND y.split IN ('val', 'test')) OR (y.split = 'train' AND x.split IN ('val', 'test'))""",
    "p3_report": f"""WITH {_TEXTS},
 s AS (SELECT DISTINCT doc_id, source, lower(trim(split, ' ' || chr(9))) AS split FROM corpus),
 p AS (SELECT a AS t, b AS h FROM alike UNION ALL SELECT b, a FROM alike)
SELECT y.split, y.source, count(*)::BIGINT AS pairs, count(DISTINCT h) AS documents FROM p JOIN s x ON x.doc_id = t JOIN s y ON y.doc_id = h
WHERE x.split = 'train' AND y.split IN ('val', 'test') GROUP BY 1, 2""",
    "p3_cover": """WITH docs AS (SELECT DISTINCT doc_id, CASE lower(trim(split, ' ' || chr(9))) WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 1 END AS side, replace(array_to_string(lines, ''), '▯', '') AS t FROM corpus),
 used AS (SELECT * FROM docs WHERE side IS NOT NULL AND length(t) >= 20),
 g AS (SELECT doc_id, side, i, substr(t, i::BIGINT, 5) AS s FROM used, LATERAL (SELECT unnest(range(1, length(t) - 3)) AS i)),
 o AS (SELECT DISTINCT side, s FROM g),
 c AS (SELECT DISTINCT g.doc_id, g.i + j AS p FROM g JOIN o ON o.s = g.s AND o.side <> g.side, LATERAL (SELECT unnest(range(5)) AS j)),
 n AS (SELECT doc_id, count(*) AS covered FROM c GROUP BY 1)
SELECT doc_id, side::INT AS split_side, length(t)::BIGINT AS letters, coalesce(covered, 0)::BIGINT AS covered FROM used LEFT JOIN n USING (doc_id)""",
    "p4_found": """WITH docs AS (SELECT DISTINCT doc_id, lines FROM corpus), l AS (SELECT doc_id, unnest(lines) AS line FROM docs),
 t AS (SELECT doc_id, substr(line, i::BIGINT, 6) AS term FROM l, LATERAL (SELECT unnest(range(1, length(line) - 4)) AS i)),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE NOT contains(term, '▯') GROUP BY 1, 2),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT doc_id, term FROM tf JOIN df USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 5""",
    "p4_scores": """WITH docs AS (SELECT DISTINCT doc_id, lines FROM corpus), l AS (SELECT doc_id, unnest(lines) AS line FROM docs),
 t AS (SELECT doc_id, substr(line, i::BIGINT, 6) AS term FROM l, LATERAL (SELECT unnest(range(1, length(line) - 4)) AS i)),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE NOT contains(term, '▯') GROUP BY 1, 2),
 df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM corpus),
 r AS (SELECT *, -log2(df / n) + log2(1 - exp(-cf / n)) AS ridf FROM df, n)
SELECT doc_id, term, tf, df, cf, round(ridf, 6) AS ridf, round(tf * ridf, 6) AS score FROM tf JOIN r USING (term) WHERE tf >= 3""",
    "p5_sample": """WITH d AS (SELECT DISTINCT doc_id, tm FROM corpus WHERE doc_id IS NOT NULL)
SELECT doc_id, tm FROM d WHERE ('0x' || substr(sha256('stemma-sample-1|' || CASE WHEN tm > 0 THEN 'tm:' || tm ELSE 'doc_id:' || doc_id END), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < 0.1""",
    "p7_found": f"""WITH RECURSIVE {_TEXTS},
 e AS (SELECT a, b FROM alike UNION SELECT b, a FROM alike),
 reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT a AS doc_id, min(b) AS group_id FROM (SELECT a, b FROM reach UNION SELECT a, a FROM reach) GROUP BY 1""",
    "p9_found": """WITH l AS (SELECT doc_id, regexp_replace(translate(lower(strip_accents(text)), 'ςϲ', 'σσ'), '[^\\p{L}]', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
 k AS (SELECT item_id, regexp_replace(translate(lower(strip_accents(text)), 'ςϲ', 'σσ'), '[^\\p{L}]', '', 'g') AS t FROM test_items WHERE text IS NOT NULL),
 d AS (SELECT doc_id, substr(t, i::BIGINT, 48) AS g FROM l, LATERAL (SELECT unnest(range(1, length(t) - 46)) AS i)),
 q AS (SELECT item_id, substr(t, i::BIGINT, 48) AS g FROM k, LATERAL (SELECT unnest(range(1, length(t) - 46)) AS i))
SELECT DISTINCT doc_id, item_id FROM d JOIN q USING (g)""",
    "p10_found": """WITH w AS (SELECT doc_id, i, md5(substr(text, i::BIGINT + 1, 200)) AS g FROM documents, LATERAL (SELECT unnest(range(0, length(text) - 199)) AS i) WHERE text IS NOT NULL),
 s AS (SELECT g FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
 p AS (SELECT DISTINCT doc_id, i FROM w SEMI JOIN s USING (g)),
 n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 200 THEN 0 ELSE 1 END AS new FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n)
SELECT doc_id, min(i)::BIGINT AS span_start, (max(i) + 200)::BIGINT AS span_end FROM r GROUP BY doc_id, run""",
}
