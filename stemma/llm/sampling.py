"""A sample that reruns, partitionings and later deliveries don't change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "stemma-sample-1"


def unit_interval(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the key and the salt alone: 52 bits of their SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), key), 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def stable_sample(docs: DataFrame, rate: float, salt: str = SALT, group: str = "tm") -> DataFrame:
    """Documents of the sample: ``doc_id`` and the group column.

    The key of a document is its positive group number, else (null, zero, negative) its
    ``doc_id``; it is hashed with a fixed salt, and values below ``rate`` are in, so documents of a
    number stay together and the documents at a lower rate are among those at a higher one.
    The first delivery decides (ties: the smallest number, null first; without a time last), hence
    later or repeated deliveries remove nobody. A delivery without a time can't be told from a later one: a dated one with
    another number, coming after it, counts as the first. Null ids are left out; rate 0 takes none, 1 all.
    """
    at = F.coalesce(F.col("loaded_at").cast("timestamp"), F.lit("9999-12-31").cast("timestamp")) if "loaded_at" in docs.columns else F.lit(0)
    first = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(at.alias("at"), F.col(group).alias("group"))).alias("x")).select("doc_id", F.col("x.group").alias(group))
    key = F.when(F.col(group) > 0, F.concat(F.lit(f"{group}:"), F.col(group).cast("string"))).otherwise(F.concat(F.lit("doc_id:"), F.col("doc_id")))
    return first.where(unit_interval(key, salt) < rate)
