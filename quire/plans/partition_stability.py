"""Stability of partition-derived topic models, end to end (flagship).

A "partition model" ranks the terms of each cluster centroid (D18 + D4),
the model the reference builds from ground-truth classes and from every
k-means iteration. Here the clusters of model (k, run) are the classes
folded onto k topics (class index mod k), evaluated on the run's sample.

Plan: the centroid sums are added up per (class, term), with a column for
all documents and one for those that each run leaves out, before they are
folded onto every k (classes and k values are few); the rows of the
documents are read once and never repeated by run or k.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.centroids import class_partition
from ..operators.packed import explode_rows
from ..operators.rankings import rank_terms
from ..operators.sampling import MODEL_KEY, sample_runs
from ..operators.stability import stability_by_k
from ..operators.vectorize import Corpus


def _fold(df: DataFrame, kmin: int, kmax: int) -> DataFrame:
    """Repeat each class row for every k (narrow) and fold class -> topic."""
    ks = F.explode(F.sequence(F.lit(kmin), F.lit(kmax))).alias("k")
    return df.select("*", ks).withColumn("topic", F.pmod(F.col("class_idx"), F.col("k")))


def class_fold_centroids(corpus: Corpus, kmin: int, kmax: int, runs: int,
                         ratio: float = 0.8, seed: int = 1000, algo: str = "class") -> DataFrame:
    """Centroids of every (k, run) model: model key + topic, term_idx, weight.

    Sums per (class, term) are taken once over all documents (the reference
    model); a run's sums are those minus the sums over the documents it
    leaves out, a column for each run beside those over all documents, in one
    aggregate. Neither documents nor their terms are repeated by run.
    """
    # Both are slim and stand in several places of the plan below, which would repeat all that makes them.
    classes = class_partition(corpus.docs).where(F.col("class_idx") >= 0).persist(StorageLevel.MEMORY_AND_DISK)
    ids = corpus.docs.select("doc_id")
    none = F.array().cast("array<int>")
    placed, run_ids = classes.withColumn("_out", none), range(1, runs + 1)
    if runs > 0:
        left_out = sample_runs(ids, runs, ratio, seed, complement=True).groupBy("doc_id").agg(F.collect_set("run").alias("_out"))
        placed = classes.join(left_out, "doc_id", "left").withColumn("_out", F.coalesce("_out", none)).persist(StorageLevel.MEMORY_AND_DISK)
    # A row a document meets its class and the runs that leave it out; its pairs are added up where they are taken apart.
    out_of = [F.array_contains("_out", r).alias(f"_o{r}") for r in run_ids]
    flags = [f"_o{r}" for r in run_ids]
    cells = explode_rows(corpus.rows.select("doc_id", "terms", "weights").join(placed, "doc_id").select("class_idx", "terms", "weights", *out_of),
                         ["class_idx", *flags], {"terms": "term_idx", "weights": "weight"})
    per_class = cells.groupBy("class_idx", "term_idx").agg(
        F.sum("weight").alias("_s0"), *[F.sum(F.when(F.col(f"_o{r}"), F.col("weight"))).alias(f"_s{r}") for r in run_ids])
    every = [f"_s{r}" for r in range(runs + 1)]
    # a term whose whole weight is left out cancels to rounding noise: drop it
    kept = {f"_s{r}": F.col("_s0") - F.coalesce(F.col(f"_s{r}"), F.lit(0.0)) for r in run_ids}
    sums = per_class.where("_s0 <> 0").select("class_idx", "term_idx", "_s0", *[F.when(F.abs(s) > 1e-12 * F.abs(F.col("_s0")), s).alias(c) for c, s in kept.items()])
    run_of = F.explode(F.sequence(F.lit(0), F.lit(runs))).alias("run")
    sizes = placed.groupBy("class_idx", "_out").agg(F.count(F.lit(1)).alias("_n")).select("class_idx", "_out", "_n", run_of).where(
        ~F.array_contains("_out", F.col("run"))).groupBy("run", "class_idx").agg(F.sum("_n").alias("_n"))
    folded = _fold(sums, kmin, kmax).groupBy("k", "topic", "term_idx").agg(*[F.sum(c).alias(c) for c in every]).persist(StorageLevel.MEMORY_AND_DISK)
    listed = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.col(c).alias("_s")) for r, c in enumerate(every)])).alias("_r")
    topic_sums = folded.select("k", "topic", "term_idx", listed).select("_r.run", "k", "topic", "term_idx", "_r._s").where("_s is not null")
    topic_sizes = _fold(sizes, kmin, kmax).groupBy("run", "k", "topic").agg(F.sum("_n").alias("_n"))
    # a row for each topic of each model
    cent = topic_sums.join(F.broadcast(topic_sizes.where(F.col("_n") > 0)), ["run", "k", "topic"])
    return cent.select(
        F.lit(algo).alias("algo"),
        F.when(F.col("run") == 0, F.lit("reference")).otherwise(F.lit("run")).alias("kind"),
        F.col("k").cast("int").alias("k"), F.col("run").cast("int").alias("run"),
        F.col("topic").cast("int").alias("topic"), "term_idx",
        (F.col("_s") / F.col("_n")).alias("weight"),
    )


def class_fold_rankings(corpus: Corpus, kmin: int, kmax: int, runs: int, top: int = 20,
                        ratio: float = 0.8, seed: int = 1000) -> DataFrame:
    # dense ranking reads the weights twice (values and per-topic counts): narrow steps from the persisted sums
    cent = class_fold_centroids(corpus, kmin, kmax, runs, ratio, seed)
    # the rankings are small (models x k x top) and feed several comparisons
    return rank_terms(cent, corpus.vocab, MODEL_KEY, top=top).persist(StorageLevel.MEMORY_AND_DISK)


def partition_stability(corpus: Corpus, kmin: int = 2, kmax: int = 5, runs: int = 10,
                        top: int = 20, ratio: float = 0.8, seed: int = 1000) -> DataFrame:
    """G6 over class-fold models: algo, k, stability, min/max agreement, n_runs."""
    return stability_by_k(class_fold_rankings(corpus, kmin, kmax, runs, top, ratio, seed), top)
