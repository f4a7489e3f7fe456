"""Score curves with paired bootstrap, retention, thresholds and size bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import BOOTSTRAPS, INTERVAL, LEAST_IN_BIN, LETTER_BINS, SEED
from ..functions import text as T
from ..session import Stage
from .ranking import dense_index
from .tasks import macro_f1, mae


#: Draws of a replicate that one row makes.
DRAWS = 1 << 16


def _with_one(rows: DataFrame, one: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the columns of their group's one row, or of the only row where there are no groups."""
    if by:
        return rows.join(F.broadcast(one), by)
    return rows.withColumn("_all", F.lit(0)).join(F.broadcast(one.withColumn("_all", F.lit(0))), "_all").drop("_all")


def _counts(members: DataFrame, by: list[str], col: str, kind: str, n_boot: int, seed: int) -> DataFrame:
    """``by``, ``b``, ``col``, ``times``: how often each member is drawn in replicate b, as many draws as members.

    Draw j of replicate b is a hash of (seed, group, kind, b, j), so replicates are the same for every
    level (paired), on every partitioning, and in SQL.
    """
    d = dense_index(members.select(*by, col).distinct(), [*by, col])
    if by:
        group = d.groupBy(*by).agg(F.min("index").alias("first"), F.count("*").alias("n"))
        d = d.join(F.broadcast(group), by).withColumn("index", F.col("index") - F.col("first")).drop("first", "n")
    else:
        group = d.agg(F.count("*").alias("n"))
    label = F.concat_ws("/", *[F.col(c).cast("string") for c in by]) if by else F.lit("")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rolls = group.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).repartition(n, "b")
    part = F.lit(DRAWS).cast("long")  # draws in parts, so that no array is as long as the group
    rolls = rolls.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / part))))
    rolls = rolls.withColumn("j", F.explode(F.sequence(F.col("p") * part, F.least((F.col("p") + 1) * part, F.col("n")) - 1)))
    at = F.floor(T.unit_hash(F.lit(str(seed)), label, F.lit(kind), F.col("b"), F.col("j")) * F.col("n"))
    drawn = rolls.select(*by, "b", at.alias("index")).groupBy(*by, "b", "index").agg(F.count("*").alias("times"))  # replicates x members; the planner takes it for small and would broadcast it
    return drawn.hint("merge").join(d, [*by, "index"]).select(*by, "b", col, "times").repartition(n, "b")


def replicates(preds: DataFrame, task: str, by: list[str], n_boot: int, seed: int = SEED) -> DataFrame:
    """``by``, ``cer``, ``b``, ``score`` over units and seeds drawn with replacement.

    Units are summed first per (replicate, level, seed, label), seeds after; what is shuffled is
    that table and not the product of predictions and replicates.
    """
    units = _counts(preds, by, "unit", "unit", n_boot, seed)
    seeds = _counts(preds, by, "seed", "seed", n_boot, seed)
    if task == "dating":
        rows = preds.where("y is not null and pred is not null").select(*by, "cer", "seed", "unit", F.lit("").alias("label"), F.abs(F.col("y") - F.col("pred")).alias("x"), F.lit(1.0).alias("n"))
    else:
        hit = F.coalesce(F.col("y") == F.col("pred"), F.lit(False))
        rows = preds.select(*by, "cer", "seed", "unit", F.explode(F.array(F.struct(F.col("y").alias("label"), hit.alias("hit")), F.struct(F.col("pred").alias("label"), F.lit(False).alias("hit")))).alias("s"))
        rows = rows.where("s.label is not null").select(*by, "cer", "seed", "unit", "s.label", F.col("s.hit").cast("double").alias("x"), F.lit(1.0).alias("n"))
    small = rows.groupBy(*by, "cer", "seed", "unit", "label").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    per = small.join(units, [*by, "unit"]).groupBy(*by, "b", "cer", "seed", "label").agg(F.sum(F.col("times") * F.col("x")).alias("x"), F.sum(F.col("times") * F.col("n")).alias("n"))
    got = per.join(seeds, [*by, "b", "seed"]).groupBy(*by, "b", "cer", "label").agg(F.sum(F.col("times") * F.col("x")).alias("x"), F.sum(F.col("times") * F.col("n")).alias("n"))
    if task == "dating":
        return got.select(*by, "cer", "b", (F.col("x") / F.col("n")).alias("score"))
    labels = small.groupBy(*by, "cer").agg(F.count_distinct("label").alias("labels"))
    return got.groupBy(*by, "cer", "b").agg(F.sum(2 * F.col("x") / F.col("n")).alias("s")).join(F.broadcast(labels), [*by, "cer"]).select(*by, "cer", "b", (F.col("s") / F.col("labels")).alias("score"))


def curve(preds: DataFrame, task: str = "form", n_boot: int = BOOTSTRAPS, by: list[str] | None = None, seed: int = SEED, interval: float = INTERVAL) -> DataFrame:
    """Score by level: ``cer``, ``point``, ``lo``, ``hi``, ``ret``, ``ret_lo``, ``ret_hi``, ``n``.

    Retention compares with the lowest level: of a score the quotient to it, of an error (task
    ``dating``) the inverse; replicates where it is not finite are left out. Levels are doubles.
    """
    by = by or []
    p = preds.withColumn("cer", F.col("cer").cast("double"))
    point = (mae if task == "dating" else macro_f1)(p, [*by, "cer"]).withColumnRenamed("score", "point").join(p.groupBy(*by, "cer").agg(F.count("*").alias("n")), [*by, "cer"])
    low = p.groupBy(*by).agg(F.min("cer").alias("base"))
    rep = Stage(preds.sparkSession, "replicates").save(replicates(p, task, by, n_boot, seed))  # levels x replicates, read twice
    keep = (lambda x, base: F.try_divide(base, x)) if task == "dating" else F.try_divide
    first = _with_one(rep, low, by)
    first = first.where(F.col("cer") == F.col("base")).select(*by, "b", F.col("score").alias("first"))
    q = F.array(F.lit((1 - interval) / 2), F.lit(1 - (1 - interval) / 2))
    spread = rep.join(first, [*by, "b"], "left").groupBy(*by, "cer").agg(F.percentile("score", q).alias("s"), F.percentile(keep(F.col("score"), F.col("first")), q).alias("r"))
    base = _with_one(point, low, by)
    base = base.where(F.col("cer") == F.col("base")).select(*by, F.col("point").alias("at_base"))
    full = point.join(spread, [*by, "cer"], "left")
    full = _with_one(full, base, by)
    return full.select(*by, "cer", "point", F.col("s")[0].alias("lo"), F.col("s")[1].alias("hi"), keep(F.col("point"), F.col("at_base")).alias("ret"), F.col("r")[0].alias("ret_lo"), F.col("r")[1].alias("ret_hi"), "n")


def thresholds(curves: DataFrame, by: list[str] | None = None, levels: dict[str, float] | None = None) -> DataFrame:
    """Per threshold the highest level such that the lower retention bound holds at every level up to it; null if it fails at the first. NaN and null fail."""
    by = by or []
    levels = levels or {"c95": 0.95, "c90": 0.9}
    w = W.partitionBy(*by).orderBy("cer").rowsBetween(W.unboundedPreceding, 0)  # as many rows as levels
    d = curves
    for name, least in levels.items():
        ok = F.coalesce((F.col("ret_lo") >= least) & ~F.isnan("ret_lo"), F.lit(False))
        d = d.withColumn(f"_{name}", F.min(ok.cast("int")).over(w))
    return d.groupBy(*by).agg(*[F.max(F.when(F.col(f"_{name}") == 1, F.col("cer"))).alias(name) for name in levels])


def by_size(preds: DataFrame, task: str = "form", n_boot: int = 200, least: int = LEAST_IN_BIN, edges: tuple[int, ...] = LETTER_BINS, seed: int = SEED) -> DataFrame:
    """Curve and thresholds per size of the units: ``bin``, ``cer``, ``point``, ``ret_lo``, ``n``, ``c95``, ``c90``.

    Bins with fewer than ``least`` rows at their lowest level are left out. All bins run in one plan.
    """
    p = preds.withColumn("bin", T.size_bin("letters", edges)).where("bin is not null").withColumn("cer", F.col("cer").cast("double"))
    n = p.groupBy("bin", "cer").count()
    large = n.groupBy("bin").agg(F.min_by("count", "cer").alias("n")).where(F.col("n") >= least).select("bin")
    c = curve(p.join(F.broadcast(large), "bin"), task, n_boot, ["bin"], seed)
    return c.select("bin", "cer", "point", "ret_lo", "n").join(thresholds(c, ["bin"]), "bin")


def by_size_wide(table: DataFrame, cers: list[float]) -> DataFrame:
    """One row a bin: its rows at the lowest level, thresholds, and a column ``m<level>`` of points for each level."""
    return table.groupBy("bin", "c95", "c90").agg(F.min_by("n", "cer").alias("n"), *[F.max(F.when(F.col("cer") == c, F.col("point"))).alias(f"m{c:g}") for c in cers])
