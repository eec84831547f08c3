"""Document sources (A1-A3): folders of text files, tables, stopword files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def scan_documents(spark: SparkSession, paths: list[str], glob: str | None = None) -> DataFrame:
    """A1 + B1: one row per file under ``paths`` (recursive): doc_id, label,
    text. Spark's file listing already skips names starting with '.' or
    '_'; files are read whole, in parallel, one task per split."""
    reader = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # Bytes that are no UTF-8 arrive as U+FFFD: they are dropped. The path arrives percent-encoded.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    df = reader.text(paths).select(F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")).alias("text"), path.alias("path"))
    label, doc_id = tx.doc_identity(F.col("path"))
    return df.select(doc_id.alias("doc_id"), label.alias("label"), "text", "path")


def load_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """A3: the distinct stripped, lowercased, non-empty lines of a stopword file (``term``)."""
    lines = spark.read.text(path).select(F.lower(F.trim(F.col("value"))).alias("term"))
    return lines.where(F.length("term") > 0).distinct()


def deal(df: DataFrame) -> DataFrame:
    """``df`` with its rows dealt to all cores if it is read from fewer files than there are cores.

    A Parquet file may be a single row group, which one task reads whole, and
    per-text work is far dearer than moving the text once. A table of more files
    is read in parallel as it is, so a large corpus isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df
