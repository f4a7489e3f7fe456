"""Session helpers: where intermediate tables live and how lineage is cut.

Iterative operators write their state as Parquet tables into the folder that the
cluster names in ``spark.checkpoint.dir`` and read it back. Such a table survives the
loss of an executor, is compressed, and gives the planner true sizes. Only where the
setting is absent and the master is local (tests, notebooks) a folder of our own is made;
on a cluster without the setting operators that need a folder end with an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, read from ``spark.checkpoint.dir``."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="stemma-"))
    return _LOCAL[0]


class Stage:
    """Written tables of one run of an operator; ``save`` cuts the lineage.

    Tables that are no longer read can be dropped at once with ``drop``; the others are
    removed when the interpreter ends, since a returned DataFrame may still read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/stemma-{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}  # holds the frames, so that no id is used twice
        self.n = 0
        atexit.register(self.clear)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, df: DataFrame) -> None:
        held = self.paths.pop(id(df), None)
        if held:
            self._delete(held[1])

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM may be gone already
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder: one Parquet file or a folder of parts."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
