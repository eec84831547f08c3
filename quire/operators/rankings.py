"""Term rankings and their comparison.

A ranking set is a long table: key columns + topic, rank (1-based), term,
weight. Ties are broken by term, after rounding the weight to 9 places so
that summation order cannot flip them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def topic_label(topic: Column) -> Column:
    """Default ranking label: C01, C02, ... (topic is 0-based)."""
    return F.format_string("C%02d", topic + 1)


def rank_terms(weights: DataFrame, vocab: DataFrame, key_cols: list[str], top: int = -1,
               densify: bool = True) -> DataFrame:
    """Rank the terms of each topic by weight (desc), then term.

    ``weights``: key_cols + topic, term_idx, weight (sparse: missing = 0).
    ``top < 1`` keeps every term. With ``densify``, terms of weight 0 take
    their place in the order as in a dense vector; only the candidates
    that can reach the cut are generated (the first ``top + nnz`` indexes
    of a topic with fewer than ``top`` positive weights). Densifying reads
    ``weights`` twice: persist it upstream when it is expensive. With ``top``,
    a topic is cut by rounded weight, ties at the cut included, before its
    terms are named.
    """
    keys = [*key_cols, "topic"]
    w = weights.select(*keys, "term_idx", "weight")
    if densify:
        stats = w.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_nz"), F.count_if(F.col("weight") > 0).alias("_pos"))
        n_terms = vocab.agg(F.count(F.lit(1))).scalar()
        if top > 0:
            span = F.when(F.col("_pos") >= top, F.lit(0)).otherwise(F.least(n_terms, F.col("_nz") + top))
        else:
            span = n_terms
        short = stats.withColumn("_span", span).where(F.col("_span") > 0).select(*keys, "_span")
        known = w.select(*keys, "term_idx").join(F.broadcast(short.select(*keys)), keys, "left_semi")  # a row for each topic at most
        zeros = (
            short.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_span").cast("int") - 1)).alias("term_idx"))
            .join(known, [*keys, "term_idx"], "left_anti")
            .withColumn("weight", F.lit(0.0))
        )
        w = w.unionByName(zeros)
    if top > 0:
        place = F.rank().over(Window.partitionBy(*keys).orderBy(F.round("weight", 9).desc()))
        w = w.withColumn("_place", place).where(F.col("_place") <= F.lit(top)).drop("_place")
    order = Window.partitionBy(*keys).orderBy(F.round("weight", 9).desc(), F.col("term").asc())
    named = w.join(vocab.select("term_idx", "term"), "term_idx")
    ranked = named.withColumn("rank", F.row_number().over(order))
    if top > 0:
        ranked = ranked.where(F.col("rank") <= F.lit(top))
    return ranked.select(*keys, topic_label(F.col("topic")).alias("label"),
                         F.col("rank").cast("int").alias("rank"), "term", "weight")


def truncate_rankings(rankings: DataFrame, top: int) -> DataFrame:
    """First ``top`` terms of every ranking; ``top < 1`` keeps all."""
    return rankings if top < 1 else rankings.where(F.col("rank") <= F.lit(top))


def rankings_size(rankings: DataFrame, key_cols: list[str]) -> DataFrame:
    """Length of the shortest ranking of each set."""
    lengths = rankings.groupBy(*key_cols, "topic").agg(F.count(F.lit(1)).alias("_len"))
    return lengths.groupBy(*key_cols).agg(F.min("_len").cast("bigint").alias("size"))


def ranking_arrays(rankings: DataFrame, key_cols: list[str]) -> DataFrame:
    """One row per ranking: key_cols + topic, terms (array in rank order).
    The group of a ranking is its length, bounded by the vocabulary."""
    return rankings.groupBy(*key_cols, "topic").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms")
    )


def jaccard(a: Column, b: Column) -> Column:
    """G1: |a n b| / |a u b| on the sets of two arrays; 0 without overlap."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(inter == 0, F.lit(0.0)).otherwise(inter / union)


def common_depths(a: Column, b: Column) -> Column:
    """Depth max(rank_a, rank_b) of every term common to the first t entries
    of both rankings, t = min(len a, len b)."""
    t = F.least(F.size(a), F.size(b))
    cut = F.greatest(t, F.lit(1))
    pos = F.transform(F.slice(a, 1, cut), lambda x: F.array_position(F.slice(b, 1, cut), x))
    return F.filter(F.transform(pos, lambda p, j: F.when(p > 0, F.greatest(j + 1, p.cast("int")))),
                    lambda d: d.isNotNull())


def average_jaccard_from_depths(depths: Column, t: Column) -> Column:
    """G2 given the common depths (a materialised column) and t:
    (1/t) sum_{i<=t} c_i / (2i - c_i), c_i = #depths <= i. Null when t = 0.

    c_i only changes at a depth, so the sum walks the sorted depths once with a running count."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.greatest(t, F.lit(1))),
        F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("c")),
        lambda acc, i: _add_step(acc, i, depths))
    return F.when(t > 0, step["total"] / t)


def _add_step(acc: Column, i: Column, depths: Column) -> Column:
    """One depth further: ``depths`` is sorted and holds each depth at most twice."""
    more = F.when(F.get(depths, acc["c"]) == i, F.when(F.get(depths, acc["c"] + 1) == i, 2).otherwise(1)).otherwise(0)
    c = acc["c"] + more
    return F.struct((acc["total"] + c / (2 * i - c)).alias("total"), c.alias("c"))


def with_average_jaccard(df: DataFrame, a: str, b: str, out: str = "score") -> DataFrame:
    """G2 on two array columns: (1/t) sum_{i<=t} J(a[:i], b[:i]).

    With distinct terms, |a[:i] n b[:i]| = c_i, the number of common terms
    whose depth max(rank_a, rank_b) is <= i, and |a[:i] u b[:i]| = 2i - c_i.
    The depths are a column of their own, computed once and sorted; the sum
    over i walks it with a running count.
    """
    staged = df.withColumn("_t", F.least(F.size(a), F.size(b))).withColumn(
        "_d", F.array_sort(common_depths(F.col(a), F.col(b))))
    return staged.withColumn(out, average_jaccard_from_depths(F.col("_d"), F.col("_t"))).drop("_t", "_d")


def average_jaccard(a: Column, b: Column) -> Column:
    """G2 as a single expression (for short rankings); prefer
    ``with_average_jaccard`` on a DataFrame, which stages the depths."""
    return average_jaccard_from_depths(F.array_sort(common_depths(a, b)), F.least(F.size(a), F.size(b)))


def similarity_matrix(left: DataFrame, right: DataFrame, key_cols: list[str],
                      metric: str = "average_jaccard") -> DataFrame:
    """Similarity of every (row topic, column topic) pair of two ranking
    sets with the same key: key_cols + row, col, score.

    The pairs are k1 x k2 per key (topics, not documents), a bound set by
    the model, not by the data.
    """
    a = ranking_arrays(left, key_cols).select(*key_cols, F.col("topic").alias("row"), F.col("terms").alias("ta"))
    b = ranking_arrays(right, key_cols).select(*key_cols, F.col("topic").alias("col"), F.col("terms").alias("tb"))
    pairs = a.join(b, key_cols)
    if metric == "average_jaccard":
        return with_average_jaccard(pairs, "ta", "tb").select(*key_cols, "row", "col", "score")
    return pairs.select(*key_cols, "row", "col", jaccard(F.col("ta"), F.col("tb")).alias("score"))


def rankings_wide(rankings: DataFrame, key_cols: list[str], top: int = 10) -> DataFrame:
    """P1 + P3: rows = rank 1..min(top, shortest ranking), one column per
    label, '' where a ranking has run out."""
    size = rankings_size(rankings, key_cols)
    cut = rankings.join(size, key_cols).where(F.col("rank") <= F.least(F.lit(top), F.col("size")))
    labels = [r[0] for r in cut.select("label").distinct().orderBy("label").collect()]
    wide = cut.groupBy(*key_cols, "rank").pivot("label", labels).agg(F.first("term"))
    return wide.na.fill("", labels)


def rankings_long(rankings: DataFrame, key_cols: list[str], top: int = 10) -> DataFrame:
    """P2 + P3: one line per ranking, 'label<pad>: t1, t2, ...'; the label is
    padded to the widest label + 1."""
    size = rankings_size(rankings, key_cols)
    cut = rankings.join(size, key_cols).where(F.col("rank") <= F.least(F.lit(top), F.col("size")))
    per = cut.groupBy(*key_cols, "topic", "label").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))),
                                 lambda x: x["term"]), ", ").alias("terms"))
    width = F.max(F.length("label")).over(Window.partitionBy(*key_cols)) + 1
    return per.select(*key_cols, "topic",
                      F.concat(F.rpad("label", width, " "), F.lit(": "), F.col("terms")).alias("line"))
