"""Search in damaged texts: query sets, eight methods, and their scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BM25_B, BM25_K1, BM25_N, GAP
from ..functions import text as T
from ..functions.distance import best_match
from ..session import Stage
from .ranking import top_per_group

BARRIERS = f"{GAP}\n"
METHODS = ("exact", "lev1", "lev2", "normdist", "minedit", "trigram", "tfidf_cos", "bm25")
#: Queries that are sent to the tasks at once; more go in blocks.
BLOCK = 20_000

#: Standing phrases of the documents (fixed values).
FORMULAE = (
    "χαίρειν", "πολλὰ χαίρειν", "ἐρρῶσθαί σε εὔχομαι", "ἔρρωσο", "ἐρρῶσθαι", "ἔτους", "ὁμολογεῖ", "ὁμολογοῦμεν", "ἀπέχω παρὰ σοῦ", "πρὸ μὲν πάντων",
    "εὔχομαί σε ὑγιαίνειν", "τὸ προσκύνημά σου ποιῶ", "παρὰ τῷ κυρίῳ Σαράπιδι", "διὸ ἀξιῶ", "διευτύχει", "εὐτύχει", "ἐπιδέδωκα", "σεσημείωμαι",
    "Αὐτοκράτορος Καίσαρος", "ἔγραψα ὑπὲρ αὐτοῦ", "μὴ εἰδότος γράμματα", "ὡς ἐτῶν", "ἀσπάζομαι", "ἀσπάζεταί σε", "ἀπόδος", "καθὼς πρόκειται",
    "κυρία ἡ συγγραφή", "ἐπερωτηθεὶς ὡμολόγησα", "ὑπατείας", "ἐν ἀγυιᾷ", "μετὰ κυρίου", "δηλῶ", "ἐπεὶ οὖν", "ἐρρῶσθαί σε βούλομαι",
)


def _blocks(queries: DataFrame) -> list[list[str]]:
    """The distinct queries, a stated set, in blocks of bounded size."""
    q = queries.where("query is not null and query <> ''").select("query").distinct()
    n = max(1, -(-q.count() // BLOCK))
    return [[r["query"] for r in q.where(F.pmod(F.xxhash64("query"), F.lit(n)) == i).orderBy("query").collect()] for i in range(n)]


def _stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


class _Distances:
    """Fewest edits of each of many queries to a substring of a text: bit-parallel columns, all queries at once."""

    def __init__(self, queries: list[str]):
        self.short = [q for q in queries if len(q) <= 63]
        self.long = [q for q in queries if len(q) > 63]
        self.m = np.array([len(q) for q in self.short], np.int64)
        self.top = (np.uint64(1) << (self.m - 1).astype(np.uint64)) if self.short else np.zeros(0, np.uint64)
        self.rows: dict[str, np.ndarray] = {}
        for i, q in enumerate(self.short):
            for j, c in enumerate(q):
                self.rows.setdefault(c, np.zeros(len(self.short), np.uint64))[i] |= np.uint64(1) << np.uint64(j)
        self.none = np.zeros(len(self.short), np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        one, full = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
        up, down, d = np.full(len(self.m), full), self.none.copy(), self.m.copy()
        best = self.m.copy()
        for c in text:
            if c in BARRIERS:
                up[:], down[:], d[:] = full, 0, self.m
                continue
            hit = self.rows.get(c, self.none)
            zero = (((hit & up) + up) ^ up) | hit | down
            plus, minus = down | ~(zero | up), up & zero
            d += ((plus & self.top) != 0).astype(np.int64) - ((minus & self.top) != 0)
            np.minimum(best, d, out=best)
            plus = plus << one
            up, down = (minus << one) | ~(zero | plus), plus & zero
        return np.r_[best, [best_match(q, text, BARRIERS) for q in self.long]].astype(np.int64)


def distances(units: DataFrame, queries: DataFrame, top: int = 100) -> DataFrame:
    """``query``, ``unit_id``, ``d``: fewest edits of a query to a substring of a unit that crosses no loss or line break.

    Of each task and query come all units that a distance method can hit (d <= 2, or a quarter of
    the query's length) and the task's ``top`` nearest with d below that length, which is all that ranking needs.
    The queries are a stated set, sent in blocks of bounded size; units are read once a block.
    """
    def block(qs: list[str]) -> DataFrame:
        sent = units.sparkSession.sparkContext.broadcast(qs)

        def run(batches):
            measure = _Distances(sent.value)
            names = measure.short + measure.long
            m = np.array([len(q) for q in names], np.int64)
            near: list[list[tuple[int, object]]] = [[] for _ in names]
            for batch in batches:
                out: list[tuple] = []
                for u, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    d = measure(t)
                    hit = (d <= 2) | (4 * d <= m)
                    out.extend((names[i], u, int(d[i])) for i in np.flatnonzero(hit).tolist())
                    for i in np.flatnonzero(~hit & (d < m)).tolist():
                        near[i].append((int(d[i]), u))
                        if len(near[i]) >= 2 * top:
                            near[i] = sorted(near[i])[:top]
                yield _rows(out)
            yield _rows([(names[i], u, d) for i, x in enumerate(near) for d, u in sorted(x)[:top]])

        def _rows(out):
            return pa.record_batch([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], kind), pa.array([o[2] for o in out], pa.int32())], ["query", "unit_id", "d"])

        kind = pa.string() if units.schema["unit_id"].dataType.simpleString() == "string" else pa.int64()
        return units.select("unit_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"query string, unit_id {units.schema['unit_id'].dataType.simpleString()}, d int")

    return _stacked([block(qs) for qs in _blocks(queries)])


def relevance(units: DataFrame, queries: DataFrame) -> DataFrame:
    """``query``, ``unit_id`` of the units whose text holds the query.

    Linear in the text: one automaton of all queries of a block runs over each unit.
    """
    def block(qs: list[str]) -> DataFrame:
        sent = units.sparkSession.sparkContext.broadcast(qs)

        def run(batches):
            try:
                import ahocorasick
            except ImportError:
                ahocorasick = None
            if ahocorasick and sent.value:
                auto = ahocorasick.Automaton()
                for q in sent.value:
                    auto.add_word(q, q)
                auto.make_automaton()
                find = lambda t: {q for _, q in auto.iter(t)}
            else:
                find = lambda t: {q for q in sent.value if q in t}
            for batch in batches:
                got = [(q, u) for u, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for q in sorted(find(t))]
                yield pa.record_batch([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], batch.column(0).type)], ["query", "unit_id"])

        return units.select("unit_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"query string, unit_id {units.schema['unit_id'].dataType.simpleString()}")

    return _stacked([block(qs) for qs in _blocks(queries)])


def postings(units: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """``unit_id``, ``term``, ``tf`` of all n-grams of the given sizes; counted inside each task first."""
    terms = F.concat(*[T.ngrams("text", n, BARRIERS) for n in sizes]) if len(sizes) > 1 else T.ngrams("text", sizes[0], BARRIERS)
    return units.select("unit_id", F.explode(terms).alias("term")).groupBy("unit_id", "term").agg(F.count("*").alias("tf"))


def document_frequency(train: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """``term``, ``df``: in how many units each n-gram stands."""
    return postings(train, sizes).groupBy("term").agg(F.count("*").alias("df"))


def trigram_share(units: DataFrame, queries: DataFrame) -> DataFrame:
    """``query``, ``unit_id``, ``share`` of the query's distinct trigrams that the unit has, where it has any."""
    q = queries.where("query <> ''").select("query").distinct().select("query", F.array_distinct(T.ngrams("query", 3, BARRIERS)).alias("g"))
    q = q.select("query", F.size("g").alias("n"), F.explode("g").alias("term"))
    u = units.select("unit_id", F.explode(F.array_distinct(T.ngrams("text", 3, BARRIERS))).alias("term"))
    return u.join(q, "term").groupBy("query", "unit_id").agg((F.count("*") / F.first("n")).alias("share"))


TFIDF_SIZES = (2, 3, 4)


def tfidf_scores(train: DataFrame, units: DataFrame, queries: DataFrame, top: int | None = None) -> DataFrame:
    """``query``, ``unit_id``, ``score``: cosine of tf-idf vectors of 2- to 4-grams, idf from the clean training units.

    The queries' vectors, a stated set, go to the tasks in blocks of bounded size, and each unit is scored against all of a
    block where its vector is, so that pairs which share a bigram are not shuffled. With ``top`` come only the
    best of each task and query, by rounded score and id: all that a ranking of that length needs.
    """
    n = train.count()
    idf = document_frequency(train, TFIDF_SIZES).select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = lambda p: p.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    stage = Stage(units.sparkSession, "tfidf")
    u = stage.save(weighted(postings(units, TFIDF_SIZES)).select("unit_id", "term", "w"))  # read for norms, and once a block
    norm = u.groupBy("unit_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    qs = queries.where("query <> ''").select(F.col("query").alias("unit_id"), F.col("query").alias("text")).distinct()
    q = stage.save(weighted(postings(qs, TFIDF_SIZES)).select(F.col("unit_id").alias("query"), "term", F.col("w").alias("wq")))
    kind = units.schema["unit_id"].dataType.simpleString()

    def block(names: list[str]) -> DataFrame:
        own = q.where(F.col("query").isin(names)) if len(names) < 100 else q.join(F.broadcast(units.sparkSession.createDataFrame([(x,) for x in names], "query string")), "query")
        rows = own.orderBy("term", "query").toPandas()
        terms = sorted(set(rows["term"]))
        number = {x: i for i, x in enumerate(names)}
        at = rows["query"].map(number).to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
        weight = rows["wq"].to_numpy(np.float64) if len(rows) else np.zeros(0)
        length = np.sqrt(np.bincount(at, weight * weight, len(names)))
        edge = np.searchsorted(rows["term"].to_numpy(object), np.array([*terms, None], object)[:-1]) if terms else np.zeros(0, np.int64)
        sent = units.sparkSession.sparkContext.broadcast((names, {t: i for i, t in enumerate(terms)}, np.r_[edge, len(at)].astype(np.int64), at, weight, length))
        held = u.join(F.broadcast(units.sparkSession.createDataFrame([(t,) for t in terms], "term string")), "term") if terms else u.limit(0)
        vectors = held.groupBy("unit_id").agg(F.collect_list(F.struct("term", "w")).alias("v")).join(norm, "unit_id")  # no more than the queries' terms

        def run(batches):
            names, ids, edge, at, weight, length = sent.value
            best: list[list[tuple]] = [[] for _ in names] if top else []
            for batch in batches:
                out: list[tuple[np.ndarray, np.ndarray]] = []
                own_ids = batch.column("unit_id")
                for v, norm_ in zip(batch.column("v").to_pylist(), batch.column("norm").to_pylist()):
                    t = np.array([ids[x["term"]] for x in v], np.int64)
                    size = edge[t + 1] - edge[t]
                    i = np.repeat(edge[t] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    score = np.bincount(at[i], np.repeat([x["w"] for x in v], size) * weight[i], len(names))
                    some = np.flatnonzero(score)
                    out.append((some, score[some] / (norm_ * length[some])))
                if top:
                    for unit, (some, score) in zip(own_ids.to_pylist(), out):
                        for i, x in zip(some.tolist(), score.tolist()):
                            best[i].append((-round(x, 9), unit, x))
                            if len(best[i]) >= 4 * top:
                                best[i] = sorted(best[i])[:top]
                    continue
                yield rows_of([names[i] for some, _ in out for i in some.tolist()], own_ids.take(pa.array(np.repeat(np.arange(len(out)), [len(some) for some, _ in out]))), np.concatenate([x for _, x in out]) if out else np.zeros(0))
            for i, x in enumerate(best):
                x = sorted(x)[:top]
                yield rows_of([names[i]] * len(x), pa.array([y[1] for y in x], pa.string() if kind == "string" else pa.int64()), [y[2] for y in x])

        def rows_of(query, unit, score):
            return pa.record_batch([pa.array(query, pa.string()), unit, pa.array(score, pa.float64())], ["query", "unit_id", "score"])

        return vectors.select("unit_id", "v", "norm").mapInArrow(run, f"query string, unit_id {kind}, score double")

    return _stacked([block(names) for names in _blocks(queries)])


def bm25_scores(train: DataFrame, units: DataFrame, queries: DataFrame, n: int = BM25_N, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """``query``, ``unit_id``, ``score``: BM25 over n-grams of the training vocabulary; lengths are those of the searched units."""
    count = train.count()
    df = document_frequency(train, (n,)).withColumn("idf", F.log((F.lit(float(count)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).select("term", "idf")
    u = Stage(units.sparkSession, "bm25").save(postings(units, (n,)).join(df, "term"))  # read three times
    length = u.groupBy("unit_id").agg(F.sum("tf").alias("len"))
    total = units.count()
    mean = (length.agg(F.sum("len")).first()[0] or 0) / total if total else 0.0
    part = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("len") / F.lit(float(mean or 1.0)))
    u = u.join(length, "unit_id").withColumn("w", F.col("tf") * (k1 + 1) / (F.col("tf") + part))
    q = queries.where("query <> ''").select("query").distinct().select("query", F.explode(T.query_terms("query", n)).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))
    return u.join(q, "term").groupBy("query", "unit_id").agg(F.sum(F.col("qtf") * F.col("idf") * F.col("w")).alias("score"))


def best(scores: DataFrame, score: str, top: int = 100, high: bool = True) -> DataFrame:
    """The first ``top`` units of each query with ``rank``; scores are rounded for stable ties, which the smaller id wins; zero scores are no find."""
    s = F.round(F.col(score), 9)
    kept = scores.where(s > 0) if high else scores
    return top_per_group(kept, ["query"], [s.desc() if high else s.asc(), F.col("unit_id").asc()], top, spread="unit_id").select("query", "unit_id", "rank")


def run_methods(units: DataFrame, queries: DataFrame, train: DataFrame | None = None, methods: tuple[str, ...] = METHODS, top: int = 100) -> tuple[DataFrame, DataFrame]:
    """Hits (``method``, ``query``, ``unit_id``) and rankings (with ``rank``) of every method over one corpus.

    ``units`` and ``train`` have ``unit_id`` and ``text``. Vector methods take their idf from ``train``, which they need.
    """
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}")
    if train is None and {"tfidf_cos", "bm25"} & set(methods):
        raise ValueError("tfidf_cos and bm25 need the clean training units")
    hits, ranked = [], []
    m = F.length("query")
    add = lambda out, name, df: out.append(df.select(F.lit(name).alias("method"), *df.columns))
    if {"exact", "lev1", "lev2", "normdist", "minedit"} & set(methods):
        d = Stage(units.sparkSession, "distances").save(distances(units, queries, top))
        order = best(d.where(F.col("d") < m), "d", top, high=False)
        for name, ok in (("exact", F.col("d") == 0), ("lev1", F.col("d") <= 1), ("lev2", F.col("d") <= 2), ("normdist", 4 * F.col("d") <= m)):
            if name in methods:
                add(hits, name, d.where(ok).select("query", "unit_id"))
        if "normdist" in methods:
            add(ranked, "normdist", order.join(d.where(4 * F.col("d") <= m).select("query", "unit_id"), ["query", "unit_id"], "left_semi"))
        if "minedit" in methods:
            add(ranked, "minedit", order)
    if "trigram" in methods:
        s = trigram_share(units, queries)
        add(hits, "trigram", s.where("share >= 0.5").select("query", "unit_id"))
        add(ranked, "trigram", best(s, "share", top))
    if "tfidf_cos" in methods:
        add(ranked, "tfidf_cos", best(tfidf_scores(train, units, queries, top), "score", top))
    if "bm25" in methods:
        add(ranked, "bm25", best(bm25_scores(train, units, queries), "score", top))
    empty = units.sparkSession.createDataFrame([], f"method string, query string, unit_id {units.schema['unit_id'].dataType.simpleString()}, rank int")
    return _stacked(hits or [empty.drop("rank")]), _stacked(ranked or [empty])


FILTERS = ("exact", "lev1", "lev2", "normdist", "trigram")


def metrics(hits: DataFrame, ranked: DataFrame, relevant: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """Per method: filter precision, recall and F1 over all pairs, and the means of recall@20, MRR and nDCG@10.

    The means run over the queries that a method ranks anything for and that have a relevant unit; their
    number is ``n_ranked``. Methods that only rank have null filter scores.
    """
    spark = hits.sparkSession
    rel = relevant.select("query", "unit_id").distinct().withColumn("rel", F.lit(1))
    names = spark.createDataFrame([(m, m in FILTERS) for m in methods], "method string, filters boolean")
    found = hits.join(rel, ["query", "unit_id"], "left").groupBy("method").agg(F.count("*").alias("hits"), F.count("rel").alias("tp"))
    total = relevant.select("query", "unit_id").distinct().count()
    p, r = F.coalesce(F.try_divide("tp", "hits"), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.lit(total)), F.lit(0.0))
    per_rel = rel.groupBy("query").agg(F.count("*").alias("n_rel"))
    gain = F.when(F.col("rel").isNotNull() & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    per = ranked.join(rel, ["query", "unit_id"], "left").groupBy("method", "query").agg(F.count(F.when(F.col("rank") <= 20, F.col("rel"))).alias("in20"), F.min(F.when(F.col("rel").isNotNull(), F.col("rank"))).alias("first"), F.sum(gain).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    per = per.join(per_rel, "query").select("method", (F.col("in20") / F.least(F.col("n_rel"), F.lit(20))).alias("recall20"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("gain") / ideal).alias("ndcg10"))
    means = per.groupBy("method").agg(F.avg("recall20").alias("recall20"), F.avg("mrr").alias("mrr"), F.avg("ndcg10").alias("ndcg10"), F.count("*").alias("n_ranked"))
    full = names.join(found, "method", "left").join(means, "method", "left").withColumn("p", p).withColumn("r", r)
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    only = lambda c, n: F.when(F.col("filters"), c).alias(n)
    return full.select("method", only(F.col("p"), "filter_p"), only(F.col("r"), "filter_r"), only(f1, "filter_f1"), "recall20", "mrr", "ndcg10", F.coalesce("n_ranked", F.lit(0)).alias("n_ranked"))


def formula_queries(spark) -> DataFrame:
    return spark.createDataFrame([(f,) for f in FORMULAE], "phrase string").select(T.letters_only("phrase").alias("query")).where("query <> ''")


def _chosen(df: DataFrame, n: int, salt: str) -> DataFrame:
    """``n`` of the distinct queries, those with the smallest hash."""
    return df.select("query").distinct().orderBy(F.sha2(F.concat(F.lit(f"{salt}|"), "query"), 256), "query").limit(n)


def synthetic_queries(units: DataFrame, per_length: int = 100, lengths: tuple[int, int] = (3, 12), salt: str = "synthetic") -> DataFrame:
    """Substrings of units, ``per_length`` distinct ones of each length, each occurrence as likely as any other.

    Every occurrence has a hash; a substring has that of its luckiest, and those with the smallest are taken.
    """
    sizes = range(lengths[0], lengths[1] + 1)

    def placed(n: int) -> Column:
        return F.transform(T.ngrams("text", n, BARRIERS), lambda g, i: F.struct(F.lit(n).alias("n"), i.alias("at"), g.alias("query")))

    grams = F.flatten(F.array(*map(placed, sizes)))
    each = units.select("unit_id", F.explode(grams).alias("x")).select("unit_id", "x.*")
    luck = F.sha2(F.concat_ws("|", F.lit(salt), "n", F.col("unit_id").cast("string"), "at"), 256)
    lucky = each.groupBy("n", "query").agg(F.min(luck).alias("h"))
    return top_per_group(lucky, ["n"], [F.col("h").asc(), F.col("query").asc()], per_length, spread="query").select("query")


def name_queries(forms: DataFrame, n: int = 500, least: int = 2) -> DataFrame:
    """``n`` of the name forms that at least ``least`` documents have."""
    return _chosen(forms.groupBy(F.col("form").alias("query")).agg(F.count("*").alias("n")).where(F.col("n") >= least), n, "names")


def headword_queries(lines: DataFrame, train: DataFrame, n: int = 1000, column: str = "value") -> DataFrame:
    """``n`` of the stems of a dictionary's headwords that stand in a training unit."""
    stems = lines.select(T.headword_stem(column).alias("query")).where("query is not null").distinct()
    return _chosen(relevance(train, stems), n, "headwords")


def build_queries(test: DataFrame, forms: DataFrame | None = None, dictionary: DataFrame | None = None, train: DataFrame | None = None, n_dictionary: int = 1000, n_names: int = 500, n_synthetic: int = 100) -> DataFrame:
    """``set``, ``query`` of the query sets, each query standing in a test unit."""
    sets = {"formulae": formula_queries(test.sparkSession), "synthetic": synthetic_queries(test, n_synthetic)}
    if forms is not None:
        sets["names"] = name_queries(forms, n_names)
    if dictionary is not None:
        sets["headwords"] = headword_queries(dictionary, train, n_dictionary)
    every = _stacked([q.select(F.lit(name).alias("set"), "query") for name, q in sets.items()]).distinct()
    every = Stage(test.sparkSession, "queries").save(every)
    return every.join(relevance(test, every).select("query").distinct(), "query", "left_semi").select("set", "query")
