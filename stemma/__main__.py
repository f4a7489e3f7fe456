"""Command line: python -m stemma {corpus,experiment,search,queries} --data DIR --out DIR."""

from __future__ import annotations

import argparse
import os

from .config import CERS, TEST_SEEDS
from .functions import markup
from .operators import degrade, models, search
from .plans import pipeline
from .sources import readers, sinks


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="stemma")
    ap.add_argument("step", choices=("corpus", "experiment", "search", "queries"))
    ap.add_argument("--data", default=os.environ.get("STEMMA_DATA", "data"))
    ap.add_argument("--out", default="out")
    ap.add_argument("--labels", help="CSV of type labels")
    ap.add_argument("--dictionary", help="text whose lines begin with headwords")
    ap.add_argument("--task", default="genre", choices=("form", "dating", "genre"))
    ap.add_argument("--model", default="tfidf", choices=(*models.MODELS, *models.NEURAL))
    ap.add_argument("--regime", default="clean", choices=("clean", "matched"))
    ap.add_argument("--cers", type=float, nargs="*", default=list(CERS))
    ap.add_argument("--seeds", type=int, nargs="*", default=list(TEST_SEEDS))
    ap.add_argument("--variant", default="base", choices=tuple(degrade.VARIANTS))
    ap.add_argument("--lost-lines", type=float, default=0)
    ap.add_argument("--limit", type=int, help="units of the smallest hashes of each split (experiment) or of the searched split (search)")
    ap.add_argument("--checkpoint", help="folder that all executors share, for intermediate tables")
    a = ap.parse_args(argv)
    spark = pipeline.default_session(a.checkpoint)
    if a.step == "corpus":
        docs = pipeline.build_corpus(readers.read_editions(spark, a.data), readers.read_dates(spark, a.data), readers.read_labels(spark, a.labels) if a.labels else None)
        sinks.write_corpus(pipeline.split_corpus(docs), f"{a.out}/corpus")
        pipeline.report(readers.read_corpus(spark, f"{a.out}/corpus")).show()
        return
    docs = readers.read_corpus(spark, f"{a.out}/corpus")
    if a.step == "experiment":
        tag = pipeline.run_tag(a.task, a.model, a.regime, a.variant, a.lost_lines)
        preds = pipeline.experiment(docs, a.task, a.model, a.regime, tuple(a.cers), tuple(a.seeds), a.limit, a.variant, a.lost_lines)
        sinks.write_predictions(preds, f"{a.out}/{tag}")
        curve, limits = pipeline.curve_of(spark.read.parquet(f"{a.out}/{tag}"), a.task)
        sinks.write_curve(curve, f"{a.out}/{tag}_curve")
        curve.show()
        limits.show()
        return
    from pyspark.sql import functions as F

    from .functions import text as T

    units = docs.select(F.col("doc_id").alias("unit_id"), T.joined("lines").alias("text"), "split")
    forms = markup.name_forms(docs.where("split = 'train'")) if "raw" in docs.columns else None
    words = readers.read_dictionary(spark, a.dictionary) if a.dictionary else None
    queries = search.build_queries(units.where("split = 'test'"), forms, words, units.where("split = 'train'"))
    sinks.write_queries(queries, f"{a.out}/queries")
    if a.step == "queries":
        queries.groupBy("set").count().show()
        return
    curve = pipeline.search_curve(docs, spark.read.json(f"{a.out}/queries"), tuple(c for c in a.cers if c <= 50), a.seeds[0], limit=a.limit)
    sinks.write_curve(curve, f"{a.out}/search_curve")
    curve.show()


if __name__ == "__main__":
    main()
