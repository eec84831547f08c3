"""Stability of a number of topics.

All algorithms, k values and runs go through one query: the reference
ranking set of each (algo, k) is paired with every run of the same (algo, k)
by an equi-join on (algo, k); the pairs are topics, k x k per run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matching import ranking_set_agreement
from .rankings import similarity_matrix, truncate_rankings

GROUP = ["algo", "k"]


def reference_pair_scores(rankings: DataFrame, top: int = 20) -> DataFrame:
    """Similarity matrix of the reference set against each run:
    algo, k, run, row (reference topic), col (run topic), score."""
    cut = truncate_rankings(rankings, top)
    ref = cut.where(F.col("kind") == "reference").drop("run")
    runs = cut.where(F.col("kind") == "run")
    left = ref.select(*GROUP, "topic", "rank", "term")
    right = runs.select(*GROUP, "run", "topic", "rank", "term")
    # the reference side is repeated for every run of its (algo, k)
    run_keys = runs.select(*GROUP, "run").distinct()
    left = left.join(run_keys, GROUP)
    return similarity_matrix(left, right, [*GROUP, "run"])


def run_agreement(rankings: DataFrame, top: int = 20) -> DataFrame:
    """G5 per run: algo, k, run, agreement (mean matched similarity)."""
    return ranking_set_agreement(reference_pair_scores(rankings, top), [*GROUP, "run"])


def stability_by_k(rankings: DataFrame, top: int = 20) -> DataFrame:
    """Mean / min / max agreement of the reference with the runs, per k."""
    agree = run_agreement(rankings, top)
    return agree.groupBy(*GROUP).agg(
        F.avg("agreement").alias("stability"),
        F.min("agreement").alias("min_agreement"),
        F.max("agreement").alias("max_agreement"),
        F.count(F.lit(1)).cast("bigint").alias("n_runs"),
    )


def best_k(stability: DataFrame) -> DataFrame:
    """K ordered by stability (highest first, then smaller k) per algo."""
    w = Window.partitionBy("algo").orderBy(F.round("stability", 9).desc(), F.col("k").asc())
    return stability.select("algo", "k", "stability", F.row_number().over(w).cast("bigint").alias("position"))
