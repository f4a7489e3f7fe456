"""The functions that SQL lacks, for use in ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .distance import best_match_udf, edit_distance_udf


@udtf(returnType="place int, term string")
class LetterNgrams:
    """``place`` (from 0) and ``term`` of the overlapping n-grams of a text, none across a loss or line break."""

    def eval(self, text: str, n: int):
        for at in range(len(text or "") - n + 1):
            term = text[at : at + n]
            if "▯" not in term and "\n" not in term:
                yield at, term


def register(spark: SparkSession) -> None:
    """``edit_distance(a, b)``, ``best_match(query, text)`` and the table function ``letter_ngrams(text, n)``."""
    spark.udf.register("edit_distance", edit_distance_udf)
    spark.udf.register("best_match", best_match_udf)
    spark.udtf.register("letter_ngrams", LetterNgrams)
