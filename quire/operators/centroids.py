"""Centroids of partitions and class partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .indexing import ordered_index
from .packed import explode_rows


def build_centroids(doc_terms: DataFrame, partition: DataFrame | None, key_cols: list[str]) -> DataFrame:
    """Mean vector per (model, topic); topics < 0 are ignored.

    ``partition``: key_cols + doc_id + topic. The mean divides by the
    cluster size, so documents without terms count as zero vectors.
    ``doc_terms``: (doc_id, term_idx, weight), or rows with lists (``Corpus.rows``),
    which meet the partition a row a document and are taken apart after that.
    Rows with lists that have the key and the topic too need no ``partition`` and no join.
    Output: key_cols + topic, term_idx, weight.
    """
    part = (doc_terms if partition is None else partition).where(F.col("topic") >= 0)
    sizes = part.groupBy(*key_cols, "topic").agg(F.count(F.lit(1)).alias("_n"))
    lists = "terms" in doc_terms.columns
    joined = part if partition is None else doc_terms.select("doc_id", *(["terms", "weights"] if lists else ["term_idx", "weight"])).join(
        part.select(*key_cols, "doc_id", "topic"), "doc_id")
    cells = explode_rows(joined, [*key_cols, "topic"], {"terms": "term_idx", "weights": "weight"}) if lists else joined
    sums = cells.groupBy(*key_cols, "topic", "term_idx").agg(F.sum("weight").alias("_s"))
    return sums.join(sizes, [*key_cols, "topic"]).select(
        *key_cols, "topic", "term_idx", (F.col("_s") / F.col("_n")).alias("weight")
    )


def label_index(docs: DataFrame, label_col: str = "label") -> DataFrame:
    """Index of each distinct label in sorted order: (label, class_idx)."""
    labels = docs.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("label")).distinct()
    return ordered_index(labels, ["label"], "class_idx").withColumn("class_idx", F.col("class_idx").cast("int"))


def class_partition(docs: DataFrame, label_col: str = "label", kept: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, class_idx); documents without a class get -1. ``kept``: columns of the documents that stay beside
    them; such rows stay where they are, the index (a row a class) goes to them."""
    idx = label_index(docs, label_col)
    return (
        docs.select("doc_id", F.col(label_col).alias("label"), *kept).join(F.broadcast(idx) if kept else idx, "label", "left")
        .select("doc_id", F.coalesce(F.col("class_idx"), F.lit(-1)).cast("int").alias("class_idx"), *kept)
    )


def missing_class_docs(clustered: DataFrame, classes: DataFrame) -> DataFrame:
    """E2 check: clustered ids that have no class (the reference raises)."""
    return clustered.select("doc_id").distinct().join(classes.select("doc_id"), "doc_id", "left_anti")
