"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup
from ..functions import text as T
from ..operators import degrade, grouping, joins, nested, search, stats, tasks
from ..session import Stage, table
from ..streaming import stateless
from . import pipeline

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _place(j: str) -> str:
    return f"""list_filter(CASE json_type({j}) WHEN 'ARRAY' THEN CAST({j} AS JSON[]) WHEN 'OBJECT' THEN [{j}] ELSE [] END, lambda x: json_type(x) = 'OBJECT')"""


_TREE = f"""raw AS (SELECT DISTINCT doc_id, 'supplied' AS field, supplied AS v FROM corpus UNION SELECT DISTINCT doc_id, 'gap', gap FROM corpus),
 once AS (SELECT doc_id, field, CAST(v AS JSON) AS j FROM raw WHERE json_valid(v)),
 val AS (SELECT doc_id, field, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN CAST(j ->> '$' AS JSON) END ELSE j END AS j FROM once),
 top AS (SELECT doc_id, field, {_place('j')} AS l FROM val WHERE j IS NOT NULL),
 n AS (
  SELECT doc_id, field, CAST(i AS VARCHAR) AS node, '' AS parent, '' AS link, l[i] AS j FROM top, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)
  UNION ALL
  SELECT doc_id, field, node || '.' || i, node, link, l[i] FROM (
   SELECT doc_id, field, node, link, {_place('k')} AS l FROM (SELECT doc_id, field, node, x AS link, json_extract(j, '$.' || x) AS k FROM n, LATERAL (SELECT unnest(['children', 'child', 'extent']) AS x)) WHERE k IS NOT NULL
  ), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))"""
_JSON_FIELDS = ["supplied", "gap"]


@query(
    f"""WITH RECURSIVE {_TREE}
SELECT DISTINCT doc_id, field, node, parent FROM n
UNION ALL
SELECT DISTINCT doc_id, 'hgv', id, '' FROM (SELECT doc_id, unnest(string_split_regex(h, '\\s+')) AS id FROM (SELECT doc_id, unnest(hgv) AS h FROM corpus)) WHERE id <> ''"""
)
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    corpus = table(spark, sf, "corpus")
    rows = nested.shred(corpus, _JSON_FIELDS).where(F.col("link").isin("", *nested.LINKS))
    return rows.select("doc_id", "field", "node", "parent").union(nested.list_entries(corpus, "hgv"))


_WIDE = ("break", "cert", "n", "precision.by.hand", "precision.degree", "quantity", "reason", "tag", "text", "unit")


@query(f"WITH RECURSIVE {_TREE} SELECT DISTINCT doc_id, field, node, parent, link, " + ", ".join(f"""j ->> '$.{c}' AS "{c.replace('.', '_')}\"""" for c in _WIDE) + " FROM n")
def p6_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The tables of objects, with a column for each inlined attribute that the schema graph shows."""
    corpus = table(spark, sf, "corpus")
    graph = Stage(spark, "graph").save(nested.schema_graph(corpus, _JSON_FIELDS))
    tables = nested.tables_of(graph)
    return nested.inlined(nested.shred(corpus, _JSON_FIELDS, tables=tables), nested.singletons(graph, tables))


@query(f"""WITH RECURSIVE {_TREE},
 a AS (SELECT DISTINCT doc_id, field, node, x AS name, CAST(json_extract(j, '$.' || x) AS JSON[]) AS l FROM n, LATERAL (SELECT unnest(['children', 'child', 'extent']) AS x) WHERE json_type(j, '$.' || x) = 'ARRAY')
SELECT doc_id, field, node, name, i::INT AS position, l[i] ->> '$' AS value FROM a, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) WHERE json_type(l[i]) = 'VARCHAR'""")
def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    return nested.repeated(nested.shred(table(spark, sf, "corpus"), _JSON_FIELDS))


@query(f"""WITH RECURSIVE {_TREE},
 o AS (SELECT doc_id, field, node AS id, '' AS element, j FROM (SELECT DISTINCT * FROM n) WHERE parent = ''
  UNION ALL SELECT doc_id, field, id || '/' || k || i, k, e[i] FROM (SELECT doc_id, field, id, k, {_place("json_extract(j, '$.' || k)")} AS e FROM o, LATERAL (SELECT unnest(json_keys(j)) AS k)), LATERAL (SELECT unnest(range(1, len(e) + 1)) AS i)),
 v AS (SELECT field, element, k AS name, json_extract(j, '$.' || k) AS v FROM o, LATERAL (SELECT unnest(json_keys(j)) AS k)),
 x AS (SELECT field, element, name, unnest(CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS JSON[]) ELSE [v] END) AS v, json_type(v) = 'ARRAY' AS many FROM v),
 g AS (SELECT field, element, name, json_type(v) = 'OBJECT' AS is_object, many, count(*) AS n FROM (SELECT field, element, name, coalesce(v, CAST('null' AS JSON)) AS v, many FROM x) GROUP BY ALL),
 e AS (SELECT DISTINCT element AS a, name AS b FROM g WHERE is_object),
 reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
 t AS (SELECT name FROM g WHERE is_object AND many UNION SELECT b FROM e GROUP BY 1 HAVING count(*) > 1 UNION SELECT a FROM reach WHERE a = b)
SELECT field, element, name, is_object, many, n, CASE WHEN CASE WHEN is_object THEN name IN (SELECT name FROM t) ELSE many END THEN 'table' ELSE 'column' END AS stored FROM g""")
def p6_schema(spark: SparkSession, sf: str) -> DataFrame:
    graph = Stage(spark, "graph").save(nested.schema_graph(table(spark, sf, "corpus"), _JSON_FIELDS))
    return nested.stored(graph, nested.tables_of(graph))


# --- the operators of the engine over the test tables -----------------------------------------


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct documents of the corpus; a second delivery has the same content. The one shuffle has a named number of partitions, which small tables keep."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf, "corpus").where("doc_id is not null").drop("loaded_at").repartition(n, "doc_id").dropDuplicates(["doc_id"]).withColumn("split", F.lower(F.trim("split", F.lit(" \t"))))


def _units(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("unit_id"), T.joined("lines").alias("text"))


_D = "(SELECT DISTINCT ON (doc_id) * REPLACE (lower(trim(split, ' ' || chr(9))) AS split) FROM corpus WHERE doc_id IS NOT NULL)"
_P = "(SELECT DISTINCT * FROM predictions)"
_FROM, _TO = "ςϲϐϑϕϱϰϖϝϟ", "σσβθφρκπϛϙ"
_GREEK, _ASCII = "αβγδεζηθικλμνξοπρστυφχψωϛϙϡ", "abcdefghijklmnopqrstuvwxyz0"  # DuckDB's levenshtein counts bytes
_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _norm(t: str) -> str:
    kept = f"regexp_replace(translate(lower(strip_accents(regexp_replace({t}, '{_SPACES}+', ' ', 'g'))), '{_FROM}', '{_TO}'), '[^{_GREEK}▯ ]', '', 'g')"
    return f"regexp_replace(trim(regexp_replace({kept}, ' +', ' ', 'g')), '▯( *▯)+', '▯', 'g')"


def _letters(t: str) -> str:
    return f"length(regexp_replace({t}, '[▯ \\n]', '', 'g'))"


def _unit(expr: str) -> str:
    return f"(('0x' || substr(sha256({expr}), 1, 16))::UBIGINT::DOUBLE / pow(2, 64))"


def _split_of(key: str) -> str:
    h = _unit(f"'20260913:' || {key}")
    return f"CASE WHEN {h} < 0.8 THEN 'train' WHEN {h} < 0.9 THEN 'val' ELSE 'test' END"


@query(f"SELECT split, count(*) AS docs, sum({_letters('array_to_string(lines, chr(10))')})::BIGINT AS letters FROM {_D} GROUP BY 1")
def corpus_report(spark, sf):
    return pipeline.report(_docs(spark, sf).withColumn("letters", T.letters_in("lines")))


@query(f"SELECT doc_id, {_norm('text')} AS normal FROM documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize("text").alias("normal"))


@query(f"SELECT {_split_of('doc_id::VARCHAR')} AS split, count(*) AS docs, coalesce(sum({_letters(_norm('text'))}), 0)::BIGINT AS letters FROM documents GROUP BY 1")
def normalized_report(spark, sf):
    d = stateless.split(stateless.normalized(table(spark, sf, "documents")), "doc_id")
    return d.groupBy("split").agg(F.count("*").alias("docs"), F.coalesce(F.sum("letters"), F.lit(0)).cast("long").alias("letters"))


@query(f"SELECT doc_id, coalesce({_letters('array_to_string(lines, chr(10))')}, 0)::INT AS letters, len(list_filter(lines, lambda x: {_letters('x')} > 0))::INT AS text_lines, array_to_string(list_transform(words, lambda x: replace(x, ' ', '')), chr(10)) AS text FROM {_D}")
def letter_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", T.letters_in("lines").alias("letters"), T.text_lines("lines").alias("text_lines"), T.joined(F.transform("words", T.without_blanks)).alias("text"))


@query(f"""WITH l AS (SELECT doc_id, unnest(CASE WHEN len(lines) > 0 THEN list_transform(lines, lambda x: length(replace(x, '▯', ''))) ELSE [0] END) AS n FROM {_D})
SELECT doc_id, count(*) AS lines, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n)::INT AS min, max(n)::INT AS max, quantile_cont(n, 0.5)::DOUBLE AS median, quantile_cont(n, 0.25)::DOUBLE AS p25, quantile_cont(n, 0.75)::DOUBLE AS p75 FROM l GROUP BY 1""")
def line_stats(spark, sf):
    return tasks.line_features(_docs(spark, sf)).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query(f"""SELECT CASE WHEN letters < 1 THEN '0' WHEN letters < 20 THEN '1–19' WHEN letters < 50 THEN '20–49' WHEN letters < 100 THEN '50–99' WHEN letters < 200 THEN '100–199' WHEN letters < 500 THEN '200–499'
 WHEN letters < 1000 THEN '500–999' WHEN letters < 2000 THEN '1000–1999' WHEN letters >= 2000 THEN '≥2000' END AS bin, count(*) AS docs FROM {_D} GROUP BY 1""")
def size_bins(spark, sf):
    return _docs(spark, sf).groupBy(T.size_bin("letters").alias("bin")).agg(F.count("*").alias("docs"))


def _grams(n: int, where: str = "true") -> str:
    return f"SELECT doc_id, i, g FROM (SELECT doc_id, i, substr(t, i::BIGINT, {n}) AS g FROM (SELECT doc_id, array_to_string(lines, chr(10)) AS t FROM {_D} WHERE {where}), LATERAL (SELECT unnest(range(1, length(t) - {n - 2})) AS i)) WHERE NOT regexp_matches(g, '[▯\\n]')"


@query(f"SELECT g AS term, count(DISTINCT doc_id) AS df, count(*)::BIGINT AS cf FROM ({_grams(6)}) GROUP BY 1")
def ngram_terms(spark, sf):
    return search.postings(_units(_docs(spark, sf)), (6,)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"""SELECT doc_id, coalesce(n, 0)::INT AS shingles FROM {_D} LEFT JOIN (SELECT doc_id, count(DISTINCT substr(t, i::BIGINT, 5)) AS n
 FROM (SELECT doc_id, replace(array_to_string(lines, ''), '▯', '') AS t FROM {_D}), LATERAL (SELECT unnest(range(1, length(t) - 3)) AS i) GROUP BY 1) USING (doc_id)""")
def shingle_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(T.shingles(F.replace(F.array_join("lines", ""), F.lit("▯"), F.lit("")))).alias("shingles"))


@query(f"SELECT doc_id, len(list_filter(string_split(array_to_string(lines, chr(10)), ''), lambda c: contains('{_GREEK}', c) AND c <> ''))::INT AS places FROM {_D}")
def letter_places(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(T.letter_positions(T.joined("lines"))).alias("places"))


@query("SELECT DISTINCT hgv_id, date_lo, CASE WHEN date_lo <> 0 THEN date_lo END AS year FROM hgv_dates WHERE date_lo IS NOT NULL")
def year_parse(spark, sf):
    d = table(spark, sf, "hgv_dates").where("date_lo is not null")
    return d.select("hgv_id", "date_lo", T.year(F.concat(F.when(F.col("date_lo") < 0, " -").otherwise(" "), F.lpad(F.abs("date_lo").cast("string"), 4, "0"), F.lit("-01-01"))).alias("year")).distinct()


_KEY = "url_decode(replace(regexp_extract(regexp_replace(trim(papyri_info), '/+$', ''), '[^/]*$'), '+', '%2B'))"


@query(f"SELECT DISTINCT papyri_info, {_KEY} AS hybrid FROM grammateus")
def url_keys(spark, sf):
    return table(spark, sf, "grammateus").select("papyri_info", T.url_key("papyri_info").alias("hybrid")).distinct()


_DATES = "(SELECT hgv_id, (max([date_lo, date_hi]))[1] AS date_lo, (max([date_lo, date_hi]))[2] AS date_hi FROM hgv_dates WHERE hgv_id IS NOT NULL AND date_lo IS NOT NULL AND date_hi IS NOT NULL GROUP BY 1)"


@query(f"""WITH h AS (SELECT doc_id, unnest(hgv) AS hgv_id, unnest(range(len(hgv))) AS pos FROM {_D} WHERE hgv IS NOT NULL),
 f AS (SELECT doc_id, arg_min(date_lo, pos) AS date_lo, arg_min(date_hi, pos) AS date_hi FROM h JOIN {_DATES} USING (hgv_id) GROUP BY 1)
SELECT doc_id, f.date_lo::INT AS date_lo, f.date_hi::INT AS date_hi, (f.date_lo::DOUBLE + f.date_hi) / 2 AS date_mid, (f.date_hi - f.date_lo)::INT AS date_width FROM {_D} d LEFT JOIN f USING (doc_id)""")
def first_match_dates(spark, sf):
    d = joins.first_match(_docs(spark, sf), joins.one_date_per_id(table(spark, sf, "hgv_dates")), "hgv", "hgv_id", ["date_lo", "date_hi"])
    return d.withColumn("date_mid", T.middle("date_lo", "date_hi")).withColumn("date_width", F.col("date_hi") - F.col("date_lo"))


_LABELS = f"(SELECT hybrid, any_value(gram_type) AS gram_type, any_value(gram_subtype) AS gram_subtype FROM (SELECT DISTINCT {_KEY} AS hybrid, gram_type, gram_subtype FROM grammateus) WHERE hybrid IS NOT NULL GROUP BY 1 HAVING count(*) = 1)"


@query(f"SELECT * FROM {_LABELS}")
def unambiguous_labels(spark, sf):
    return joins.labels_by_url(table(spark, sf, "grammateus"))


@query(f"SELECT doc_id, CASE WHEN source = 'ddbdp' THEN l.gram_type END AS gram_type, CASE WHEN source = 'ddbdp' THEN l.gram_subtype END AS gram_subtype FROM {_D} d LEFT JOIN {_LABELS} l USING (hybrid)")
def labelled_documents(spark, sf):
    return joins.with_labels(_docs(spark, sf), joins.labels_by_url(table(spark, sf, "grammateus")))


@query(f"SELECT doc_id, coalesce(tm IN (SELECT tm FROM {_D} WHERE tm IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) = 2), false) AS in_both FROM {_D}")
def keys_in_both(spark, sf):
    return joins.key_in_both(_docs(spark, sf))


@query(f"SELECT doc_id, gram_type AS y FROM {_D} WHERE gram_type IS NOT NULL AND letters > 0")
def task_form(spark, sf):
    return tasks.form_task(_docs(spark, sf)).select("doc_id", "y")


@query(f"SELECT doc_id, date_mid AS y, coalesce(date_width <= 100, false) AS evaluated FROM {_D} WHERE date_mid IS NOT NULL AND letters > 0")
def task_dating(spark, sf):
    return tasks.dating_task(_docs(spark, sf)).select("doc_id", "y", "evaluated")


@query(f"SELECT doc_id, source AS y FROM {_D} WHERE NOT coalesce(tm_in_both, false) AND letters > 0")
def task_genre(spark, sf):
    return tasks.genre_task(_docs(spark, sf)).select("doc_id", "y")


@query(f"SELECT doc_id, split FROM {_D} QUALIFY row_number() OVER (PARTITION BY split ORDER BY sha256('sample|' || doc_id), doc_id) <= 50")
def sample_per_split(spark, sf):
    return tasks.sample_per_group(_docs(spark, sf), 50).select("doc_id", "split")


_GROUP = f"(SELECT doc_id, CASE WHEN tm > 0 THEN min(doc_id) OVER (PARTITION BY tm) ELSE doc_id END AS group_id FROM {_D})"


@query(f"SELECT doc_id, group_id, {_split_of('group_id')} AS split FROM {_GROUP}")
def number_groups(spark, sf):
    docs = _docs(spark, sf)
    return grouping.grouped_splits(docs, grouping.number_edges(docs))


@query()
def minhash_groups(spark, sf):
    docs = _docs(spark, sf)
    return grouping.grouped_splits(docs, grouping.number_edges(docs).union(grouping.minhash_pairs(docs)))


@query(f"""WITH g AS (SELECT doc_id, CASE WHEN tm > 0 THEN 'tm ' || tm ELSE doc_id END AS g, gram_type AS label FROM {_D} WHERE gram_type IS NOT NULL),
 per AS (SELECT g, label, count(*) AS n FROM g GROUP BY 1, 2),
 lead_ AS (SELECT g, arg_max(label, struct_pack(n := n, l := label)) AS label, sum(n) AS size, '[' || string_agg('{{' || label || ', ' || n || '}}', ', ' ORDER BY label) || ']' AS counts FROM per GROUP BY 1),
 f AS (SELECT *, ((row_number() OVER (ORDER BY label, size DESC, counts) - 1) % 5)::INT AS fold FROM lead_)
SELECT label, size::BIGINT AS size, counts, fold, count(*) AS groups, 0::BIGINT AS torn FROM f GROUP BY ALL""")
def fold_counts(spark, sf):
    """How many groups of each label and make-up every fold has, and how many groups are in two folds."""
    docs = _docs(spark, sf).drop("fold").where("gram_type is not null").withColumn("g", F.when(F.col("tm") > 0, F.concat(F.lit("tm "), F.col("tm").cast("string"))).otherwise(F.col("doc_id")))
    folds = Stage(spark, "folds").save(grouping.stratified_folds(docs, "g", "gram_type"))
    placed = docs.join(folds, "g").groupBy("g", F.col("gram_type").alias("label"), "fold").agg(F.count("*").alias("n"))
    one = placed.groupBy("g").agg(F.max_by("label", F.struct("n", "label")).alias("label"), F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("label", "n"))).cast("string").alias("counts"), F.min("fold").alias("fold"), F.max("fold").alias("other"))
    return one.groupBy("label", "size", "counts", "fold").agg(F.count("*").alias("groups"), F.count_if(F.col("fold") != F.col("other")).alias("torn"))


@query()
def group_folds(spark, sf):
    docs = _docs(spark, sf)
    groups = grouping.grouped_splits(docs, grouping.number_edges(docs)).drop("split")
    return grouping.stratified_folds(docs.where("gram_type is not null").join(groups, "doc_id"), "group_id", "gram_type")


def _f1(pred_sql: str, by: str) -> str:
    return f"""SELECT {by}, round(avg(CASE WHEN n > 0 THEN 2.0 * tp / n ELSE 0 END), 9) AS score FROM (SELECT {by}, label, sum(tp) AS tp, sum(n) AS n FROM (
 SELECT {by}, y AS label, CASE WHEN y = pred THEN 1.0 ELSE 0 END AS tp, 1.0 AS n FROM {pred_sql} UNION ALL SELECT {by}, pred, 0, 1.0 FROM {pred_sql}) WHERE label IS NOT NULL GROUP BY {by}, label) GROUP BY {by}"""


@query(_f1(_P, "cer"))
def macro_f1(spark, sf):
    return tasks.macro_f1(table(spark, sf, "predictions").distinct(), ["cer"]).withColumn("score", F.round("score", 9))


@query(f"SELECT source, round(sum(letters * abs(date_mid - date_lo)) / nullif(sum(letters), 0), 6) AS score FROM {_D} WHERE date_mid IS NOT NULL GROUP BY 1")
def weighted_mae(spark, sf):
    return tasks.mae(_docs(spark, sf), ["source"], "date_mid", "date_lo", "letters").withColumn("score", F.round("score", 6))


def _baseline(y: str, where: str) -> str:
    guess = f"(SELECT {y} AS g FROM {_D} WHERE {where} AND split = 'train' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    p = f"(SELECT 1 AS one, {y} AS y, (SELECT g FROM {guess}) AS pred FROM {_D} WHERE {where} AND split = 'test')"
    return f"SELECT score FROM ({_f1(p, 'one')})"


@query(_baseline("gram_type", "gram_type IS NOT NULL AND letters > 0"))
def baseline_form(spark, sf):
    t = tasks.form_task(_docs(spark, sf))
    return tasks.baseline("form", t.where("split = 'train'"), t.where("split = 'test'")).withColumn("score", F.round("score", 9))


@query(_baseline("source", "NOT coalesce(tm_in_both, false) AND letters > 0"))
def baseline_genre(spark, sf):
    t = tasks.genre_task(_docs(spark, sf))
    return tasks.baseline("genre", t.where("split = 'train'"), t.where("split = 'test'")).withColumn("score", F.round("score", 9))


@query(f"""SELECT round(avg(abs(date_mid - (SELECT quantile_cont(date_mid, 0.5) FROM {_D} WHERE letters > 0 AND split = 'train'))), 6) AS score
FROM {_D} WHERE date_mid IS NOT NULL AND letters > 0 AND split = 'test' AND date_width <= 100""")
def baseline_dating(spark, sf):
    t = tasks.dating_task(_docs(spark, sf))
    return tasks.baseline("dating", t.where("split = 'train'"), t.where("split = 'test' and evaluated")).withColumn("score", F.round("score", 6))


_BOOT = 1000


def _curve_sql(preds: str, by: str, boots: int) -> str:
    """WITH parts up to ``curve`` (by, cer, point, lo, hi, ret, ret_lo, ret_hi, n); ``by`` is a column of preds."""
    def drawn(kind: str, col: str) -> str:
        h = _unit(f"'20260913|' || g || '|{kind}|' || b || '|' || j")
        return f"""{kind}_ix AS (SELECT {by} AS g, {col} AS x, row_number() OVER (PARTITION BY {by} ORDER BY {col}) - 1 AS ix FROM (SELECT DISTINCT {by}, {col} FROM p)),
 {kind}_n AS (SELECT g, count(*) AS n FROM {kind}_ix GROUP BY 1),
 {kind}_d AS (SELECT g, b, floor({h} * n)::BIGINT AS ix, count(*) AS times FROM {kind}_n, LATERAL (SELECT unnest(range({boots})) AS b), LATERAL (SELECT unnest(range(n)) AS j) GROUP BY 1, 2, 3),
 {kind}_w AS MATERIALIZED (SELECT g, b, x, times FROM {kind}_d JOIN {kind}_ix USING (g, ix))"""
    return f"""p AS ({preds}), {drawn('unit', 'unit')}, {drawn('seed', 'seed')},
 s AS MATERIALIZED (SELECT {by} AS g, cer, seed, unit, y AS label, CASE WHEN y = pred THEN 1.0 ELSE 0 END AS tp FROM p WHERE y IS NOT NULL UNION ALL SELECT {by}, cer, seed, unit, pred, 0 FROM p WHERE pred IS NOT NULL),
 k AS (SELECT g, cer, count(DISTINCT label) AS labels FROM s GROUP BY 1, 2),
 pt AS (SELECT g, cer, sum(2.0 * tp / n) / count(*) AS point FROM (SELECT g, cer, label, sum(tp) AS tp, count(*) AS n FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2),
 rl AS (SELECT s.g, u.b, cer, label, sum(u.times * e.times * tp) AS tp, sum(u.times * e.times) AS n FROM s JOIN unit_w u ON u.g = s.g AND u.x = s.unit JOIN seed_w e ON e.g = s.g AND e.b = u.b AND e.x = s.seed GROUP BY 1, 2, 3, 4),
 rep AS MATERIALIZED (SELECT rl.g, b, rl.cer, sum(2.0 * tp / n) / any_value(labels) AS score FROM rl JOIN k ON k.g = rl.g AND k.cer = rl.cer GROUP BY 1, 2, 3),
 low AS (SELECT {by} AS g, min(cer) AS base FROM p GROUP BY 1),
 fst AS (SELECT rep.g, b, score AS first FROM rep JOIN low ON low.g = rep.g AND low.base = rep.cer),
 sp AS (SELECT rep.g, cer, quantile_cont(score, 0.025) AS lo, quantile_cont(score, 0.975) AS hi, quantile_cont(CASE WHEN first <> 0 THEN score / first END, 0.025) AS ret_lo, quantile_cont(CASE WHEN first <> 0 THEN score / first END, 0.975) AS ret_hi FROM rep LEFT JOIN fst ON fst.g = rep.g AND fst.b = rep.b GROUP BY 1, 2),
 nn AS (SELECT {by} AS g, cer, count(*) AS n FROM p GROUP BY 1, 2),
 curve AS (SELECT pt.g, pt.cer, pt.point, sp.lo, sp.hi, CASE WHEN bp.point <> 0 THEN pt.point / bp.point END AS ret, sp.ret_lo, sp.ret_hi, nn.n FROM pt JOIN nn ON nn.g = pt.g AND nn.cer = pt.cer JOIN low ON low.g = pt.g JOIN pt bp ON bp.g = pt.g AND bp.cer = low.base LEFT JOIN sp ON sp.g = pt.g AND sp.cer = pt.cer)"""


_ALL = f"SELECT *, '' AS grp FROM {_P}"
_LIMITS = """lim AS (SELECT g, max(CASE WHEN a THEN cer END) AS c95, max(CASE WHEN b THEN cer END) AS c90 FROM (SELECT g, cer, bool_and(coalesce(round(ret_lo, 9) >= 0.95, false)) OVER w AS a, bool_and(coalesce(round(ret_lo, 9) >= 0.9, false)) OVER w AS b FROM curve WINDOW w AS (PARTITION BY g ORDER BY cer)) GROUP BY 1)"""


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in cols})


@query(f"WITH {_curve_sql(_ALL, 'grp', _BOOT)} SELECT cer, round(point, 9) AS point, round(lo, 9) AS lo, round(hi, 9) AS hi, round(ret, 9) AS ret, round(ret_lo, 9) AS ret_lo, round(ret_hi, 9) AS ret_hi, n FROM curve")
def bootstrap_curve(spark, sf):
    c = stats.curve(table(spark, sf, "predictions").distinct(), "genre", _BOOT)
    return _rounded(c, "point", "lo", "hi", "ret", "ret_lo", "ret_hi")


@query(f"WITH {_curve_sql(_ALL, 'grp', _BOOT)}, {_LIMITS} SELECT c95, c90 FROM lim")
def curve_thresholds(spark, sf):
    return stats.thresholds(_rounded(stats.curve(table(spark, sf, "predictions").distinct(), "genre", _BOOT), "ret_lo"))


_BIN = "CASE WHEN letters < 1 THEN '0' WHEN letters < 20 THEN '1–19' WHEN letters < 50 THEN '20–49' WHEN letters < 100 THEN '50–99' WHEN letters < 200 THEN '100–199' WHEN letters < 500 THEN '200–499' WHEN letters < 1000 THEN '500–999' WHEN letters < 2000 THEN '1000–1999' WHEN letters >= 2000 THEN '≥2000' END"
_BINNED = f"SELECT * FROM (SELECT *, {_BIN} AS bin FROM {_P}) WHERE bin IN (SELECT bin FROM (SELECT {_BIN} AS bin, cer, count(*) AS n FROM {_P} GROUP BY 1, 2) GROUP BY 1 HAVING arg_min(n, cer) >= 30)"


@query(f"WITH {_curve_sql(_BINNED, 'bin', 200)}, {_LIMITS} SELECT curve.g AS bin, cer, round(point, 9) AS point, round(ret_lo, 9) AS ret_lo, n, c95, c90 FROM curve JOIN lim USING (g)")
def curve_by_size(spark, sf):
    return _rounded(stats.by_size(table(spark, sf, "predictions").distinct(), "genre"), "point", "ret_lo")


_LOST = "|| '|20|7|' ||"


@query(f"""WITH l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM {_D}),
 t AS (SELECT *, regexp_matches(line, '[{_GREEK}]') AS has FROM l),
 r AS (SELECT *, CASE WHEN has THEN row_number() OVER (PARTITION BY doc_id, has ORDER BY sha256(doc_id {_LOST} i)) END AS rk, count(*) FILTER (has) OVER (PARTITION BY doc_id) AS n FROM t),
 kept AS (SELECT doc_id, line, i FROM r WHERE NOT has OR rk > least(round_even(0.2 * n, 0)::INT, n - 1))
SELECT d.doc_id, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS text FROM {_D} d LEFT JOIN kept USING (doc_id) GROUP BY 1""")
def lost_lines(spark, sf):
    return _docs(spark, sf).select("doc_id", T.joined(degrade.kept_lines("lines", 20, "doc_id", F.lit("20"), F.lit("7"))).alias("text"))


def _kept_sql(p: float, seed: int) -> str:
    """Table ``kept``: documents without the lines that are lost at ``p`` percent."""
    if not p:
        return f"kept AS (SELECT doc_id, lines FROM {_D})"
    return f"""l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM {_D}),
 h AS (SELECT *, regexp_matches(line, '[{_GREEK}]') AS has FROM l),
 o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, has ORDER BY sha256(doc_id || '|{p:g}|{seed}|' || i)) AS rk, count(*) FILTER (has) OVER (PARTITION BY doc_id) AS m FROM h),
 kept AS (SELECT d.doc_id, coalesce(list(line ORDER BY i) FILTER (line IS NOT NULL AND (NOT has OR rk > least(round_even({p:.1f} / 100 * m, 0)::INT, m - 1))), []) AS lines FROM {_D} d LEFT JOIN o USING (doc_id) GROUP BY 1)"""


def _budget_sql(c: float, seed: int, variant: str, p: float = 0) -> str:
    cap = "n" if variant == "bursty" else "(n + 1) // 2"
    return f"""{_kept_sql(p, seed)},
 d AS (SELECT doc_id, lines, length(regexp_replace(array_to_string(lines, ''), '[^{_GREEK}]', '', 'g')) AS n FROM kept),
 b AS (SELECT round_even({c:.1f} / 100 * sum(n), 0)::BIGINT AS total, sum(n) AS s FROM d),
 x AS (SELECT doc_id, lines, n, total, total::DOUBLE * n / s AS exact, floor(total::DOUBLE * n / s) AS whole FROM d, b),
 r AS (SELECT *, total - sum(whole) OVER () AS left_, row_number() OVER (ORDER BY CASE WHEN n > 0 AND {cap} > whole THEN exact - whole ELSE -1 END DESC, sha256('{c:g}|{seed}|{variant}|' || doc_id)) AS rk FROM x),
 k AS (SELECT doc_id, lines, n, (whole + CASE WHEN rk <= left_ THEN 1 ELSE 0 END)::BIGINT AS k FROM r)"""


@query(f"WITH {_budget_sql(10, 1, 'base')} SELECT doc_id, n AS letters, k FROM k")
def cer_budget(spark, sf):
    return degrade.budget(_docs(spark, sf), 10, 1).select("doc_id", "letters", "k")


def _damage(spark, sf, c, seed, variant="base", p=0.0):
    """Degraded texts held against the clean ones: ``distance`` of the letters by the built-in function, ``rest`` (all that is no letter),
    ``as_named``: whether the edits that the operator names turn the clean text into its own, ``subs``: whether all are substitutions."""
    docs = _docs(spark, sf)
    clean = docs.select("doc_id", T.joined(degrade.kept_lines("lines", p, "doc_id", F.lit(degrade.level(p)), F.lit(str(seed)))).alias("clean"))
    got = degrade.degrade(docs, c, seed, variant, p).join(clean, "doc_id").withColumn("text", T.joined("lines"))
    only = lambda x: F.regexp_replace(x, f"[^{_GREEK}]+", "")
    edit = F.aggregate("edits", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda acc, e: F.struct(
        F.concat(acc["out"], F.substring(F.col("clean"), acc["at"] + 1, e["at"] - acc["at"]), e["letter"], F.when(e["op"] == 1, F.substring(F.col("clean"), e["at"] + 1, F.lit(1))).otherwise("")).alias("out"), (e["at"] + 1).alias("at")))
    again = F.concat(edit["out"], F.substring(F.col("clean"), edit["at"] + 1, F.length("clean")))
    kinds = F.array_distinct(F.transform("edits", lambda e: e["op"]))
    return got.select("doc_id", "letters", "k", F.levenshtein(only("clean"), only("text")).cast("long").alias("distance"), F.regexp_replace("text", f"[{_GREEK}]+", "").alias("rest"),
                      (again == F.col("text")).alias("as_named"), "exact", (F.size(F.array_except(kinds, F.array(F.lit(0)))) == 0).alias("subs"))


def _damage_sql(c, seed, variant="base", p=0.0):
    return f"WITH {_budget_sql(c, seed, variant, p)} SELECT doc_id, n AS letters, k, k AS distance, regexp_replace(array_to_string(lines, chr(10)), '[{_GREEK}]', '', 'g') AS rest, true AS as_named, true AS exact FROM k"


# In the next five the SQL gives what must hold of any draw: the edits of each text, their distance, and all that they must not touch.


@query(_damage_sql(10, 1))
def degraded_texts(spark, sf):
    return _damage(spark, sf, 10, 1).drop("subs")


@query(_damage_sql(20, 2, "bursty", 10))
def bursty_texts(spark, sf):
    return _damage(spark, sf, 20, 2, "bursty", 10).drop("subs")


@query(_damage_sql(10, 1, "sub_only").replace("true AS exact", "true AS exact, true AS subs"))
def substituted_texts(spark, sf):
    return _damage(spark, sf, 10, 1, "sub_only")


@query(_damage_sql(15, 3, "uniform"))
def uniform_texts(spark, sf):
    return _damage(spark, sf, 15, 3, "uniform").drop("subs")


@query(_damage_sql(5, 1, "uneven", 20))
def uneven_texts(spark, sf):
    return _damage(spark, sf, 5, 1, "uneven", 20).drop("subs")


@query(f"""WITH f AS (SELECT DISTINCT f.form AS query FROM (SELECT unnest({[f for f in search.FORMULAE]}) AS p), LATERAL (SELECT regexp_replace({_norm('p')}, '[^{_GREEK}]', '', 'g') AS form) f)
SELECT query FROM f""")
def formula_queries(spark, sf):
    return search.formula_queries(spark).distinct()


_TOKENS = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
 ts AS (SELECT doc_id, i, list_filter(string_split_regex(line, '""" + _SPACES + """+'), lambda x: x <> '') AS t FROM l),
 k AS (SELECT doc_id, i, unnest(t) AS token, unnest(range(len(t))) AS j FROM ts),
 b AS (SELECT *, coalesce(lag(token) OVER (PARTITION BY doc_id ORDER BY i, j), '.') AS before FROM k)"""


@query(f"""WITH {_TOKENS}
SELECT DISTINCT doc_id, form FROM (SELECT doc_id, regexp_replace({_norm('token')}, '[^{_GREEK}]', '', 'g') AS form FROM b
 WHERE regexp_matches(token, '^\\P{{L}}*(\\p{{Lu}}|[\\x{{1f88}}-\\x{{1f8f}}\\x{{1f98}}-\\x{{1f9f}}\\x{{1fa8}}-\\x{{1faf}}\\x{{1fbc}}\\x{{1fcc}}\\x{{1ffc}}])') AND NOT contains(token, '▯') AND NOT regexp_matches(before, '[.·;:]$')) WHERE length(form) >= 4""")
def name_forms(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"), F.lit(False).alias("runs_on"))).alias("raw"))
    return markup.name_forms(d)


_STEM = "CASE " + " ".join(f"WHEN w LIKE '%{e}' AND length(w) >= {len(e) + 4} THEN left(w, length(w) - {len(e)})" for e in T.ENDINGS) + " ELSE w END"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
 h AS (SELECT DISTINCT regexp_replace({_norm("regexp_extract(line, '^' || '" + _SPACES + "' || '*([^' || '" + _SPACES[1:-1] + "' || ']+)' || '" + _SPACES + "' || '*[.,]', 1)")}, '[^{_GREEK}]', '', 'g') AS w FROM l)
SELECT DISTINCT {_STEM} AS stem FROM h WHERE length(w) >= 4""")
def headword_stems(spark, sf):
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.select(T.headword_stem("line").alias("stem")).where("stem is not null").distinct()


_FORMS_SQL = SQL["name_forms"]


@query(f"SELECT form AS query FROM (SELECT form, count(*) AS n FROM ({_FORMS_SQL}) GROUP BY 1) WHERE n >= 2 ORDER BY sha256('names|' || form), form LIMIT 500")
def name_queries(spark, sf):
    return search.name_queries(name_forms(spark, sf))


_N_SYN = 100
_IS_TEST, _IS_TRAIN = "split = 'test'", "split = 'train'"


def _train_and_test(spark, sf, stage):
    docs = stage.save(_docs(spark, sf).where("split in ('train', 'test')").select("doc_id", "lines", "split"))
    return _units(docs.where("split = 'train'")), _units(docs.where("split = 'test'"))


def _sets(spark, sf, test, train):
    words = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return search.build_queries(test, name_forms(spark, sf), words, train)


def _test_and_queries(spark, sf):
    """The tables of a search: clean training units, test units, and all four query sets at their full size."""
    stage = Stage(spark, "catalog")
    train, test = _train_and_test(spark, sf, stage)
    return train, test, stage.save(_sets(spark, sf, test, train).select("query").distinct())


_SYN = " UNION ALL ".join(
    f"(SELECT g AS query FROM (SELECT g, min(sha256('synthetic|{n}|' || doc_id || '|' || pos)) AS h FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM ({_grams(n, _IS_TEST)})) GROUP BY 1) ORDER BY h, g LIMIT {_N_SYN})"
    for n in range(3, 13)
)
_TEST = f"(SELECT doc_id AS unit_id, array_to_string(lines, chr(10)) AS text FROM {_D} WHERE split = 'test')"
_TRAIN = _TEST.replace("'test'", "'train'")
_SETS = f"""SELECT set_, query FROM (SELECT 'formulae' AS set_, query FROM ({SQL['formula_queries']}) UNION SELECT 'synthetic', query FROM ({_SYN}) UNION SELECT 'names', query FROM ({SQL['name_queries']})
 UNION SELECT 'headwords', query FROM (SELECT stem AS query FROM ({SQL['headword_stems']}) WHERE stem IN (SELECT stem FROM ({SQL['headword_stems']}), {_TRAIN} WHERE contains(text, stem)) ORDER BY sha256('headwords|' || stem), stem LIMIT 1000))
 WHERE query IN (SELECT query FROM (SELECT query FROM ({SQL['formula_queries']}) UNION SELECT query FROM ({_SYN}) UNION SELECT query FROM ({SQL['name_queries']}) UNION SELECT stem FROM ({SQL['headword_stems']})), {_TEST} WHERE contains(text, query))"""
_Q = f"SELECT DISTINCT query FROM ({_SETS})"


@query(_Q)
def search_queries(spark, sf):
    return _test_and_queries(spark, sf)[2]


@query(f"SELECT query, unit_id FROM ({_Q}) JOIN {_TEST} ON contains(text, query)")
def search_exact(spark, sf):
    _, test, queries = _test_and_queries(spark, sf)
    return search.run_methods(test, queries, methods=("exact",))[0].select("query", "unit_id")


@query(f"SELECT query, unit_id FROM ({_Q}) JOIN {_TEST} ON contains(text, query)")
def search_relevance(spark, sf):
    _, test, queries = _test_and_queries(spark, sf)
    return search.relevance(test, queries)


@query()
def search_distances(spark, sf):
    _, test, queries = _test_and_queries(spark, sf)
    hits, ranked = search.run_methods(test, queries, methods=("lev1", "lev2", "normdist", "minedit"))
    return hits.withColumn("rank", F.lit(None).cast("int")).union(ranked.select("method", "query", "unit_id", "rank"))


def _q_terms(n: int) -> str:
    return f"SELECT query, substr(query, i::BIGINT, {n}) AS g FROM q, LATERAL (SELECT unnest(range(1, length(query) - {n - 2})) AS i)"


@query(f"""WITH q AS ({_Q}), qt AS (SELECT DISTINCT * FROM ({_q_terms(3)})), n AS (SELECT query, count(*) AS n FROM qt GROUP BY 1), u AS (SELECT DISTINCT doc_id AS unit_id, g FROM ({_grams(3, _IS_TEST)})),
 s AS (SELECT query, unit_id, count(*) / any_value(n)::DOUBLE AS share FROM u JOIN qt USING (g) JOIN n USING (query) GROUP BY 1, 2)
SELECT query, unit_id, round(share, 9) AS share, row_number() OVER (PARTITION BY query ORDER BY round(share, 9) DESC, unit_id)::INT AS rank FROM s QUALIFY rank <= 100""")
def search_trigram(spark, sf):
    _, test, queries = _test_and_queries(spark, sf)
    s = search.trigram_share(test, queries)
    return search.best(s, "share").join(s, ["query", "unit_id"]).select("query", "unit_id", F.round("share", 9).alias("share"), "rank")


def _post(where: str, sizes) -> str:
    return " UNION ALL ".join(f"SELECT doc_id AS unit_id, g FROM ({_grams(n, where)})" for n in sizes)


@query(f"""WITH q AS ({_Q}), n AS (SELECT count(*) AS n FROM {_D} WHERE {_IS_TRAIN}), idf AS (SELECT g, ln((1.0 + any_value(n)) / (1 + count(DISTINCT unit_id))) + 1 AS idf FROM ({_post(_IS_TRAIN, (2, 3, 4))}), n GROUP BY 1),
 u AS (SELECT unit_id, g, count(*) * any_value(idf) AS w FROM ({_post(_IS_TEST, (2, 3, 4))}) JOIN idf USING (g) GROUP BY 1, 2), nu AS (SELECT unit_id, sqrt(sum(w * w)) AS nu FROM u GROUP BY 1),
 qt AS (SELECT query, g, count(*) * any_value(idf) AS wq FROM ({_q_terms(2)} UNION ALL {_q_terms(3)} UNION ALL {_q_terms(4)}) JOIN idf USING (g) GROUP BY 1, 2), nq AS (SELECT query, sqrt(sum(wq * wq)) AS nq FROM qt GROUP BY 1),
 s AS (SELECT query, unit_id, sum(w * wq) / (any_value(nu) * any_value(nq)) AS score FROM u JOIN qt USING (g) JOIN nu USING (unit_id) JOIN nq USING (query) GROUP BY 1, 2)
SELECT query, unit_id, round(score, 6) AS score FROM s""")
def search_tfidf(spark, sf):
    train, test, queries = _test_and_queries(spark, sf)
    return search.tfidf_scores(train, test, queries).select("query", "unit_id", F.round("score", 6).alias("score"))


@query(f"""WITH q AS ({_Q}), n AS (SELECT count(*) AS n FROM {_D} WHERE {_IS_TRAIN}), idf AS (SELECT g, ln((any_value(n) - count(DISTINCT unit_id) + 0.5) / (count(DISTINCT unit_id) + 0.5) + 1) AS idf FROM ({_post(_IS_TRAIN, (6,))}), n GROUP BY 1),
 u AS (SELECT unit_id, g, count(*) AS tf, any_value(idf) AS idf FROM ({_post(_IS_TEST, (6,))}) JOIN idf USING (g) GROUP BY 1, 2),
 qt AS (SELECT query, g, count(*) AS qtf FROM ({_q_terms(6)}) GROUP BY 1, 2),
 s AS (SELECT query, unit_id, sum(qtf * idf * tf * 1.3 / (tf + 0.3)) AS score FROM u JOIN qt USING (g) GROUP BY 1, 2)
SELECT query, unit_id, round(score, 6) AS score FROM s""")
def search_bm25(spark, sf):
    train, test, queries = _test_and_queries(spark, sf)
    return search.bm25_scores(train, test, queries).select("query", "unit_id", F.round("score", 6).alias("score"))


_RANKED = ("exact", "trigram", "tfidf_cos", "bm25")


def _unrounded(name: str) -> str:
    """The scores of a search's SQL before they are rounded and cut to the best."""
    return SQL[name].rsplit("\nSELECT", 1)[0] + "\nSELECT * FROM s"


def _best_sql(name: str, score: str) -> str:
    return f"SELECT '{name}' AS method, query, unit_id, row_number() OVER (PARTITION BY query ORDER BY round({score}, 9) DESC, unit_id) AS rank FROM {name} WHERE round({score}, 9) > 0 QUALIFY rank <= 100"


@query(f"""WITH rel AS ({SQL['search_relevance']}), q AS ({_Q}), trigram AS ({_unrounded('search_trigram')}), tfidf_cos AS ({_unrounded('search_tfidf')}), bm25 AS ({_unrounded('search_bm25')}),
 hits AS (SELECT 'exact' AS method, query, unit_id FROM rel UNION ALL SELECT 'trigram', query, unit_id FROM trigram WHERE share >= 0.5),
 ranked AS ({_best_sql('trigram', 'share')} UNION ALL {_best_sql('tfidf_cos', 'score')} UNION ALL {_best_sql('bm25', 'score')}),
 found AS (SELECT method, count(*) AS hits, count(rel.query) AS tp FROM hits LEFT JOIN rel USING (query, unit_id) GROUP BY 1),
 nrel AS (SELECT query, count(*) AS n FROM rel GROUP BY 1),
 per AS (SELECT method, query, count(CASE WHEN rank <= 20 THEN rel.query END) AS in20, min(CASE WHEN rel.query IS NOT NULL THEN rank END) AS first_, sum(CASE WHEN rel.query IS NOT NULL AND rank <= 10 THEN 1 / log2(rank + 1.0) ELSE 0 END) AS gain FROM ranked LEFT JOIN rel USING (query, unit_id) GROUP BY 1, 2),
 means AS (SELECT method, avg(in20 / least(n, 20)::DOUBLE) AS recall20, avg(coalesce(1.0 / first_, 0)) AS mrr, avg(gain / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1.0)))) AS ndcg10, count(*) AS n_ranked FROM per JOIN nrel USING (query) GROUP BY 1),
 p AS (SELECT m.method, tp / hits::DOUBLE AS p, tp / (SELECT count(*) FROM rel)::DOUBLE AS r, recall20, mrr, ndcg10, coalesce(n_ranked, 0) AS n_ranked FROM (SELECT unnest({list(_RANKED)}) AS method) m LEFT JOIN found USING (method) LEFT JOIN means USING (method))
SELECT method, round(p, 9) AS filter_p, round(r, 9) AS filter_r, round(2 * p * r / (p + r), 9) AS filter_f1, round(recall20, 9) AS recall20, round(mrr, 9) AS mrr, round(ndcg10, 9) AS ndcg10, n_ranked FROM p""")
def search_metrics(spark, sf):
    return _metrics(spark, sf, _RANKED)


@query()
def search_metrics_distances(spark, sf):
    return _metrics(spark, sf, ("lev1", "lev2", "normdist", "minedit"))


def _metrics(spark, sf, methods):
    train, test, queries = _test_and_queries(spark, sf)
    stage = Stage(spark, "metrics")
    hits, ranked = search.run_methods(test, queries, train, methods)
    got = search.metrics(stage.save(hits), stage.save(ranked), stage.save(search.relevance(test, queries)), methods)
    return got.select("method", *[F.round(c, 9).alias(c) for c in ("filter_p", "filter_r", "filter_f1", "recall20", "mrr", "ndcg10")], "n_ranked")


@query(f"SELECT doc_id, letters, array_to_string(list_transform(words, lambda x: {_norm('x')}), chr(10)) AS text FROM {_D} WHERE len(words) > 0")
def rendered_editions(spark, sf):
    """Editions written as markup, a gap sign for each loss, and read again."""
    d = _docs(spark, sf).where("size(words) > 0")
    body = F.array_join(F.transform("words", lambda x: F.concat(F.lit('<lb n="1"/>'), F.replace(x, F.lit("▯"), F.lit("<supplied reason='lost'>αβγ<reg>δ</reg></supplied>")), F.lit("<note>ε</note>"))), "")
    xml = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><publicationStmt><idno type="TM">1</idno></publicationStmt></teiHeader><text><div type="edition" xml:lang="grc"><ab>'), body, F.lit("</ab></div></text></TEI>"))
    files = d.select(F.concat("doc_id", F.lit(".xml")).alias("path"), F.lit("x").alias("source"), xml.cast("binary").alias("content"))
    return markup.editions(files).select(F.regexp_extract("path", r"^(.*)\.xml$", 1).alias("doc_id"), F.col("letters").cast("int").alias("letters"), T.joined("words").alias("text"))


@query()
def model_genre(spark, sf):
    return pipeline.experiment(_docs(spark, sf), "genre", "tfidf", cers=(0, 20), seeds=(1,))


@query()
def model_dating(spark, sf):
    return pipeline.experiment(_docs(spark, sf), "dating", "tfidf", cers=(0,), seeds=(1,))


@query()
def model_linelen(spark, sf):
    return pipeline.experiment(_docs(spark, sf), "genre", "linelen", cers=(0,), seeds=(1,))


@query(f"""WITH q AS ({_Q}), seg AS (SELECT unit_id, unnest(string_split_regex(text, '[▯\\n]')) AS s FROM {_TEST}),
 pairs AS (SELECT query, unit_id, s, length(query)::BIGINT AS m FROM q, seg WHERE length(s) > 0),
 at AS (SELECT query, unit_id, s, m, unnest(range(1, length(s) + 1)) AS i FROM pairs),
 sub AS (SELECT query, unit_id, m, substr(s, i, l) AS x FROM (SELECT query, unit_id, s, m, i, unnest(range(greatest(1, m - greatest(2, m // 4)), m + greatest(2, m // 4) + 1)) AS l FROM at) WHERE i + l - 1 <= length(s) AND (m >= 12 OR contains(substr(s, i, l), left(query, m // 3)) OR contains(substr(s, i, l), substr(query, m // 3 + 1, m // 3)) OR contains(substr(s, i, l), substr(query, 2 * (m // 3) + 1)))),
 best AS (SELECT query, unit_id, m, min(levenshtein(translate(query, '{_GREEK}', '{_ASCII}'), translate(x, '{_GREEK}', '{_ASCII}'))) AS d FROM (SELECT DISTINCT * FROM sub) GROUP BY 1, 2, 3)
SELECT 'lev1' AS method, query, unit_id FROM best WHERE d <= 1 UNION ALL SELECT 'lev2', query, unit_id FROM best WHERE d <= 2 UNION ALL SELECT 'normdist', query, unit_id FROM best WHERE 4 * d <= m""".replace(" at AS (", " place AS (").replace("FROM at)", "FROM place)"))
def search_fuzzy(spark, sf):
    _, test, queries = _test_and_queries(spark, sf)
    return search.run_methods(test, queries, methods=("lev1", "lev2", "normdist"))[0]


@query()
def search_curve(spark, sf):
    _, _, queries = _test_and_queries(spark, sf)
    return pipeline.search_curve(_docs(spark, sf), queries, (0, 20))


@query(_SETS.replace("SELECT set_, query", 'SELECT set_ AS "set", query', 1))
def query_sets(spark, sf):
    return _sets(spark, sf, *_train_and_test(spark, sf, Stage(spark, "catalog"))[::-1])


_BUILT = ("date_lo", "date_hi", "date_mid", "date_width", "gram_type", "gram_subtype", "tm_in_both", "split", "fold")


@query(f"""WITH a AS ({SQL['first_match_dates']}), b AS ({SQL['labelled_documents']}), c AS ({SQL['keys_in_both']})
SELECT d.doc_id, d.source, d.tm, a.date_lo, a.date_hi, a.date_mid, a.date_width, b.gram_type, b.gram_subtype, c.in_both AS tm_in_both FROM {_D} d JOIN a USING (doc_id) JOIN b USING (doc_id) JOIN c USING (doc_id)""")
def built_corpus(spark, sf):
    docs = pipeline.build_corpus(_docs(spark, sf).drop(*_BUILT), table(spark, sf, "hgv_dates"), table(spark, sf, "grammateus"))
    return docs.select("doc_id", "source", "tm", "date_lo", "date_hi", "date_mid", "date_width", "gram_type", "gram_subtype", "tm_in_both")


@query()
def split_corpus(spark, sf):
    return pipeline.split_corpus(_docs(spark, sf)).select("doc_id", "group_id", "split", "fold")


@query()
def model_form(spark, sf):
    return pipeline.experiment(_docs(spark, sf), "form", "letterbag", cers=(0,), seeds=(1,))


@query()
def model_matched(spark, sf):
    return pipeline.experiment(_docs(spark, sf), "genre", "tfidf", "matched", cers=(10,), seeds=(1,))
