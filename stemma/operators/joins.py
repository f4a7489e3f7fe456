"""Look-ups of the corpus: first match in a list, unambiguous labels, keys on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def first_match(docs: DataFrame, lookup: DataFrame, ids: str, key: str, values: list[str], doc: str = "doc_id") -> DataFrame:
    """``doc`` and the values of the first id of its list, in list order, that ``lookup`` knows.

    Documents without a match keep nulls. ``lookup`` must have one row a key. The list is exploded
    and aggregated with ``min`` over (position, values), so a long list costs rows, not memory,
    and an id that many documents name is split by adaptive execution.
    """
    each = docs.select(doc, F.posexplode(ids).alias("at", key))
    hit = each.join(lookup.select(key, *values), key).groupBy(doc).agg(F.min(F.struct("at", *values)).alias("hit"))
    return docs.select(doc).distinct().join(hit, doc, "left").select(doc, *[F.col(f"hit.{v}").alias(v) for v in values])


def one_date_per_id(dates: DataFrame) -> DataFrame:
    """One row an id with both bounds: where an id has several, the greatest bounds (the files' last row is not known to a table)."""
    return dates.where("hgv_id is not null and date_lo is not null and date_hi is not null").groupBy("hgv_id").agg(F.max(F.struct("date_lo", "date_hi")).alias("d")).select("hgv_id", "d.date_lo", "d.date_hi")


def unambiguous(labels: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Keys with a single distinct combination of values (null equals null)."""
    x = F.struct(*values)
    return labels.groupBy(key).agg(F.min(x).alias("a"), F.max(x).alias("b")).where(F.col("a").eqNullSafe(F.col("b"))).select(key, *[F.col(f"a.{v}").alias(v) for v in values])


def labels_by_url(table: DataFrame) -> DataFrame:
    """``hybrid``, ``gram_type``, ``gram_subtype`` of a label table whose keys are URLs; contradicting keys are left out."""
    keyed = table.select(T.url_key("papyri_info").alias("hybrid"), "gram_type", "gram_subtype").where("hybrid is not null")
    return unambiguous(keyed, "hybrid", ["gram_type", "gram_subtype"])


def with_labels(docs: DataFrame, labels: DataFrame, source: str = "ddbdp") -> DataFrame:
    """``doc_id`` with the label of its ``hybrid`` where the document comes from ``source``, else null."""
    d = docs.select("doc_id", F.when(F.col("source") == source, F.col("hybrid")).alias("hybrid")).distinct()
    return d.join(labels, "hybrid", "left").select("doc_id", "gram_type", "gram_subtype")


def key_in_both(docs: DataFrame, key: str = "tm", side: str = "source", sides: tuple[str, str] = ("ddbdp", "dclp")) -> DataFrame:
    """``doc_id`` and whether its key occurs on both sides; a null key never does."""
    both = docs.where(F.col(key).isNotNull() & F.col(side).isin(*sides)).groupBy(key).agg(F.min(side).alias("a"), F.max(side).alias("b")).where("a <> b").select(key, F.lit(True).alias("in_both"))
    return docs.select("doc_id", key).distinct().join(both, key, "left").select("doc_id", F.coalesce("in_both", F.lit(False)).alias("in_both"))
