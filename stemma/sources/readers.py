"""Sources: markup files, label tables, dictionaries, written corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GREEK, Alphabet
from ..functions import markup

#: Folders below a data root and the source their editions belong to (fixed values).
EDITIONS = {"DDB_EpiDoc_XML": "ddbdp", "DCLP": "dclp"}
DATES = "HGV_meta_EpiDoc"


def files(spark: SparkSession, folder: str, pattern: str = "*.xml") -> DataFrame:
    """``path``, ``content`` of all files below a folder; files are spread over partitions by size."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return f.select("path", "content")


def edition_files(spark: SparkSession, root: str, folders: dict[str, str] = EDITIONS) -> DataFrame:
    """``path``, ``source``, ``content`` of the edition files of every folder."""
    out = None
    for folder, source in folders.items():
        part = files(spark, f"{root}/{folder}").select("path", F.lit(source).alias("source"), "content")
        out = part if out is None else out.union(part)
    return out


def read_editions(spark: SparkSession, root: str, alphabet: Alphabet = GREEK) -> DataFrame:
    """The document table of a data root; of files with one stem and source the last by path parts holds."""
    e = markup.editions(edition_files(spark, root), alphabet)
    last = e.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in e.columns if c != "doc_id"]), F.split("path", "/")).alias("x"))
    return last.select("doc_id", "x.*")


def read_dates(spark: SparkSession, root: str) -> DataFrame:
    return markup.date_records(files(spark, f"{root}/{DATES}"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label table in CSV: all strings, blanks around headers and before values don't count."""
    t = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, multiLine=True, escape='"')
    t = t.toDF(*[c.strip() for c in t.columns])
    return t.select(F.col("`papyri.info`").alias("papyri_info"), F.col("Type").alias("gram_type"), F.col("Subtype").alias("gram_subtype"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
