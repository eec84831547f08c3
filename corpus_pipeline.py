"""A training-data pipeline over ``documents``: five stages, each one operator of ``quire.llm``.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps
(the last: the packed pieces). Each result is written as Parquet in the
cluster's shared folder and read again by the next stage, so a lost executor
costs at most the stage at hand.

Documents without words left after substring dedup are dropped there; what is
left of the others takes their place, with ``n_chars`` counted anew. Rows
without a document id pass the stages that name documents by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import contamination, packing, simhash, substrings, toxicity
from quire.llm.catalog import table
from quire.llm.queries import tokenizer_path
from quire.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't find toxic."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: three words, three bits."""
    return simhash.drop_near_duplicates(docs, size=3, radius=3)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of twenty words or more that start earlier in the corpus."""
    out = substrings.deduplicate(docs, size=20, rejoin=False).where("n_words = 0 or n_removed < n_words")
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence of at most 4096 tokens and offset."""
    return packing.pack(packing.encode(docs, tokenizer_path())).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: SQL can't express the classifier, the connected components or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
