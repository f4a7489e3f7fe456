"""Ranks and top rows without a single-task sort of a whole table or of a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Stage


def dense_index(df: DataFrame, order: list[Column | str], name: str = "index") -> DataFrame:
    """The rows with their place (from 0) in a total order.

    Range-partitioned and written once, so that the partitions stay as they are; ranks are counted
    inside each partition and offset by the sizes of those before it. Only these sizes, one number
    a partition, go to the driver.
    """
    stage = Stage(df.sparkSession, "index")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that small tables keep their parallelism
    parts = stage.save(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())
    start, before = 0, []
    for p, n in sizes:
        before.append((p, start))
        start += n
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before long")
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_in", inside).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_before", "_in")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank", parts: int = 32, spread: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group in an order, with their rank from 1.

    A first cut leaves ``n`` rows of each of ``parts`` parts of a group, so that a group with a third
    of all rows is sorted in parts. ``order`` must be total within a group.
    """
    d = df.withColumn("_part", F.pmod(F.xxhash64(spread) if spread else F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(parts)))
    d = d.withColumn(rank, F.row_number().over(W.partitionBy(*by, "_part").orderBy(*order))).where(F.col(rank) <= n)
    return d.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n).drop("_part")
