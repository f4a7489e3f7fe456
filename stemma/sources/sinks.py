"""Sinks: corpora and predictions as Parquet, curves as CSV, query sets as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_corpus(docs: DataFrame, path: str) -> None:
    """Parquet, one folder a split, so that readers of one split read no other."""
    docs.write.mode("overwrite").partitionBy("split").parquet(path)


def write_predictions(preds: DataFrame, path: str) -> None:
    preds.write.mode("overwrite").parquet(path)


def write_curve(curve: DataFrame, path: str) -> None:
    """CSV with a header, in one file: a curve has a row a level."""
    curve.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_queries(queries: DataFrame, path: str) -> None:
    queries.write.mode("overwrite").json(path)
