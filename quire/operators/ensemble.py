"""Relevance functions and topic ensembles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import optimal_assignment
from .rankings import similarity_matrix


# H1-H3: rank (1-based) -> relevance
def unit_relevance(rank: Column) -> Column:
    return F.lit(1.0)


def reciprocal_relevance(rank: Column) -> Column:
    return F.lit(1.0) / rank


def log_relevance(rank: Column, base: float = 2.0) -> Column:
    return F.lit(1.0) / (F.log(rank + 1) / F.lit(math.log(base)))


RELEVANCE = {"unit": unit_relevance, "reciprocal": reciprocal_relevance, "log": log_relevance}


def relevance_table(ranks: DataFrame) -> DataFrame:
    """H4: relevance of ranks 1..n for each function; ``ranks`` has a
    column n (one row per sequence wanted)."""
    r = ranks.select(F.explode(F.sequence(F.lit(1), F.col("n"))).alias("rank")).distinct()
    return r.select("rank", *[fn(F.col("rank")).alias(name) for name, fn in RELEVANCE.items()])


def ensemble_weights(rankings: DataFrame, group_cols: list[str], relevance: str = "reciprocal") -> DataFrame:
    """H5: per group (an ensemble ranking) and term: summed relevance and the
    number of rankings added. ``rankings``: group_cols + set id column
    ``member`` + rank, term."""
    rel = RELEVANCE[relevance](F.col("rank"))
    runs = rankings.groupBy(*group_cols).agg(F.countDistinct("member").alias("runs"))
    w = rankings.groupBy(*group_cols, "term").agg(F.sum(rel).alias("weight"))
    return w.join(runs, group_cols)


def ensemble_ranking(weights: DataFrame, group_cols: list[str], top: int = -1,
                     include_weights: bool = False) -> DataFrame:
    """Terms by total weight (desc, then term); top <= 0 keeps all.
    With weights the entry reads 'term (w/runs)' with two decimals, rounded half
    up from nine decimals, so that the order of a sum can't change it."""
    order = Window.partitionBy(*group_cols).orderBy(F.round("weight", 9).desc(), F.col("term"))
    ranked = weights.withColumn("rank", F.row_number().over(order))
    if top > 0:
        ranked = ranked.where(F.col("rank") <= F.lit(top))
    mean = F.round(F.round(F.col("weight") / F.col("runs"), 9).cast("decimal(38,9)"), 2).cast("decimal(38,2)")
    entry = F.concat("term", F.lit(" ("), mean.cast("string"), F.lit(")")) if include_weights else F.col("term")
    return ranked.select(*group_cols, "rank", entry.alias("entry"))


def ensemble_score(weights: DataFrame, queries: DataFrame, group_cols: list[str]) -> DataFrame:
    """H7: weight / runs of queried (group, term) pairs, 0 when absent."""
    runs = weights.select(*group_cols, "runs").distinct()
    return (queries.join(weights.select(*group_cols, "term", "weight"), [*group_cols, "term"], "left")
            .join(runs, group_cols, "left")
            .select(*group_cols, "term", F.coalesce(F.col("weight") / F.col("runs"), F.lit(0.0)).alias("score")))


def ensemble_terms(weights: DataFrame, group_cols: list[str]) -> DataFrame:
    """H8: number of distinct terms of each ensemble ranking."""
    return weights.groupBy(*group_cols).agg(F.countDistinct("term").cast("bigint").alias("n_terms"))


def topic_ensemble(anchor: DataFrame, others: DataFrame, key_cols: list[str],
                   relevance: str = "reciprocal") -> tuple[DataFrame, DataFrame]:
    """H9 + H10: each later ranking set is matched to the anchor set (G5) and
    its rankings are added to the matched anchor topics.

    anchor: key_cols + topic, rank, term. others: key_cols + member + topic,
    rank, term. Returns (weights: key_cols + topic, term, weight, runs;
    consistency: key_cols + topic, consistency = sum of matched scores).
    """
    members = others.select(*key_cols, "member").distinct()
    left = anchor.join(members, key_cols)
    sims = similarity_matrix(left, others, [*key_cols, "member"])
    matched = optimal_assignment(sims, [*key_cols, "member"])
    moved = (others.join(matched.select(*key_cols, "member", F.col("col").alias("topic"),
                                        F.col("row").alias("anchor_topic")), [*key_cols, "member", "topic"])
             .select(*key_cols, "member", F.col("anchor_topic").alias("topic"), "rank", "term"))
    base = anchor.select(*key_cols, F.lit("__anchor__").alias("member"), "topic", "rank", "term")
    both = base.unionByName(moved.withColumn("member", F.col("member").cast("string")))
    weights = ensemble_weights(both, [*key_cols, "topic"], relevance)
    topics = anchor.select(*key_cols, "topic").distinct()
    consistency = (topics.join(matched.groupBy(*key_cols, F.col("row").alias("topic")).agg(F.sum("score").alias("c")),
                               [*key_cols, "topic"], "left")
                   .select(*key_cols, "topic", F.coalesce("c", F.lit(0.0)).alias("consistency")))
    return weights, consistency
