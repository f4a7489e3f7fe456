"""Task tables, baselines and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DATING_WIDTH, GAP


def form_task(docs: DataFrame) -> DataFrame:
    """Documents with a type and letters; ``y`` is the type."""
    return docs.where("gram_type is not null and letters > 0").withColumn("y", F.col("gram_type"))


def dating_task(docs: DataFrame, width: int = DATING_WIDTH) -> DataFrame:
    """Dated documents with letters; ``y`` is the middle of the date, ``evaluated`` whether it is narrow enough to test on."""
    return docs.where("date_mid is not null and letters > 0").withColumn("y", F.col("date_mid").cast("double")).withColumn("evaluated", F.coalesce(F.col("date_width") <= width, F.lit(False)))


def genre_task(docs: DataFrame) -> DataFrame:
    """Documents with letters whose number is not in both sources; ``y`` is the source."""
    return docs.where("not coalesce(tm_in_both, false) and letters > 0").withColumn("y", F.col("source"))


TASKS = {"form": form_task, "dating": dating_task, "genre": genre_task}


def macro_f1(preds: DataFrame, by: list[str], y: str = "y", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """``by`` and ``score``: the mean over all labels seen in y or pred of 2TP / (2TP + FP + FN), 0 where that is 0/0.

    A null prediction is no label but misses its true one. Labels are aggregated before anything
    is joined, so that only labels x groups rows remain.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    sides = preds.select(*by, F.explode(F.array(F.struct(F.col(y).alias("label"), F.lit(True).alias("t")), F.struct(F.col(pred).alias("label"), F.lit(False).alias("t")))).alias("x"), (F.col(y) == F.col(pred)).alias("hit"), w.alias("w"))
    per = sides.where("x.label is not null").groupBy(*by, "x.label").agg(F.sum(F.when(F.col("x.t") & F.col("hit"), F.col("w")).otherwise(0.0)).alias("tp"), F.sum("w").alias("n"))
    return per.withColumn("f1", F.when(F.col("n") > 0, 2 * F.col("tp") / F.col("n")).otherwise(0.0)).groupBy(*by).agg(F.avg("f1").alias("score"))


def mae(preds: DataFrame, by: list[str], y: str = "y", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """``by`` and ``score``: the weighted mean absolute error; null where the weights sum to 0."""
    w = F.col(weight) if weight else F.lit(1.0)
    return preds.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).groupBy(*by).agg(F.try_divide(F.sum(w * F.abs(F.col(y) - F.col(pred))), F.sum(w)).alias("score"))


def majority(train: DataFrame, y: str = "y") -> DataFrame:
    """The commonest value; of equally common ones the smallest."""
    return train.where(F.col(y).isNotNull()).groupBy(y).count().agg(F.min(F.struct((-F.col("count")).alias("c"), F.col(y).alias("y"))).alias("b")).select(F.col("b.y").alias("pred"))


def median(train: DataFrame, y: str = "y") -> DataFrame:
    return train.agg(F.percentile(y, F.lit(0.5)).alias("pred"))


def baseline(task: str, train: DataFrame, test: DataFrame) -> DataFrame:
    """The score of always answering with the commonest label, or for dating the median."""
    guess = median(train) if task == "dating" else majority(train)
    both = test.select("y").join(F.broadcast(guess))  # one row
    return (mae if task == "dating" else macro_f1)(both, [])


def line_features(docs: DataFrame, lines: str = "lines", gap: str = GAP) -> DataFrame:
    """``doc_id`` and eight figures on the lengths of its lines; no lines count as one of length 0."""
    lengths = docs.select("doc_id", F.explode(F.when(F.size(F.coalesce(F.col(lines), F.array().cast("array<string>"))) > 0, F.transform(lines, lambda x: F.length(F.replace(x, F.lit(gap), F.lit(""))))).otherwise(F.array(F.lit(0)))).alias("n"))
    p = F.percentile("n", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75)))
    return lengths.groupBy("doc_id").agg(F.count("*").alias("lines"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.min("n").alias("min"), F.max("n").alias("max"), p.alias("p")).select("doc_id", "lines", "mean", "std", "min", "max", F.col("p")[0].alias("median"), F.col("p")[1].alias("p25"), F.col("p")[2].alias("p75"))


def sample_per_group(docs: DataFrame, n: int, by: str = "split", key: str = "doc_id", salt: str = "sample") -> DataFrame:
    """``n`` rows of each group, those with the smallest hash of the key.

    A first cut keeps of each of 64 parts of a group its ``n`` smallest, so that no task sorts a whole group.
    """
    from pyspark.sql import Window as W

    h = F.sha2(F.concat(F.lit(f"{salt}|"), F.col(key).cast("string")), 256)
    d = docs.withColumn("_h", h).withColumn("_part", F.pmod(F.xxhash64("_h"), F.lit(64)))
    d = d.withColumn("_r", F.row_number().over(W.partitionBy(by, "_part").orderBy("_h", key))).where(F.col("_r") <= n)
    return d.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy("_h", key))).where(F.col("_r") <= n).drop("_h", "_part", "_r")
