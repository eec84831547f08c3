"""Validation against ground truth (F1-F11) as aggregates.

Partition scores work from the contingency table (class x cluster counts
per model): one shuffle of (model, doc) rows into a table whose size is
bounded by models x classes x clusters. Log-factorials for E[MI] are a
scalar expression (exact values below 20, Stirling series above), so no
lookup table grows with the number of documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .matching import ranking_set_agreement
from .rankings import jaccard, ranking_arrays, with_average_jaccard

# Stirling's error ln(x!) - (x + 1/2) ln x + x - ln(2 pi) / 2 for x = 1..15, from math.lgamma.
_STIRLING = [0.0] + [math.lgamma(x + 1) - (x + 0.5) * math.log(x) + x - 0.5 * math.log(2 * math.pi) for x in range(1, 16)]


def stirling_error(x: Column) -> Column:
    """ln(x!) less Stirling's formula, for an integer column above 0."""
    xd = x.cast("double")
    small = F.element_at(F.array(*[F.lit(v) for v in _STIRLING]), (F.least(x, F.lit(15)) + 1).cast("int"))
    x2 = xd * xd
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680) / x2) / x2) / x2) / xd
    return F.when(x < 16, small).otherwise(series)


def deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x for x above 0, without cancellation where x is near the mean."""
    v = (x - mean) / (x + mean)
    v2 = v * v
    tail = F.lit(1 / 19)
    for j in range(17, 1, -2):
        tail = 1 / j + v2 * tail
    near = (x - mean) * v + 2 * x * v * v2 * tail
    return F.when(F.abs(v) < 0.1, near).otherwise(x * F.log(x / mean) + mean - x)


def ln_binomial(x: Column, n: Column, p: Column, q: Column) -> Column:
    """ln of the binomial probability of x in n at p (q = 1 - p), in its saddle-point form."""
    xd, nd = x.cast("double"), n.cast("double")
    rest = n - x
    inner = (stirling_error(n) - stirling_error(x) - stirling_error(rest) - deviance(xd, nd * p)
             - deviance(rest.cast("double"), nd * q) + 0.5 * F.log(nd / (2 * math.pi * xd * rest.cast("double"))))
    return (F.when(n == 0, F.lit(0.0)).when(x == 0, nd * F.log1p(-p)).when(x == n, nd * F.log1p(-q)).otherwise(inner))


def contingency(pairs: DataFrame, key_cols: list[str], a: str = "class_idx", b: str = "topic") -> DataFrame:
    """n_ij per key: key_cols + a, b, n."""
    return pairs.groupBy(*key_cols, a, b).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def partition_scores(pairs: DataFrame, key_cols: list[str], a: str = "class_idx", b: str = "topic",
                     nmi_average: str = "geometric", ami_average: str = "max") -> DataFrame:
    """F4-F6 per key: mi, h_a, h_b, nmi, ami, ari.

    ``pairs``: one row per compared document with its class (a) and
    cluster (b). Averages: 'geometric' | 'arithmetic' | 'max' | 'min'.
    """
    # Classes x clusters of each model; read by all that follows, while the pairs are counted once.
    ct = contingency(pairs, key_cols, a, b).withColumnRenamed("n", "nij").persist()
    ra = ct.groupBy(*key_cols, a).agg(F.sum("nij").alias("ai"))
    rb = ct.groupBy(*key_cols, b).agg(F.sum("nij").alias("bj"))
    tot = ct.groupBy(*key_cols).agg(F.sum("nij").alias("N"))
    cell = ct.join(ra, [*key_cols, a]).join(rb, [*key_cols, b]).join(tot, key_cols)
    n, nij, ai, bj = (F.col(c).cast("double") for c in ("N", "nij", "ai", "bj"))
    mi = cell.groupBy(*key_cols).agg(
        F.sum(nij / n * F.log(n * nij / (ai * bj))).alias("mi"),
        F.sum(nij * (nij - 1) / 2).alias("sum_nij2"),
    )
    ha = ra.join(tot, key_cols).groupBy(*key_cols).agg(
        (-F.sum(F.col("ai") / F.col("N") * F.log(F.col("ai") / F.col("N")))).alias("h_a"),
        F.sum(F.col("ai").cast("double") * (F.col("ai") - 1) / 2).alias("sum_a2"),
        F.count(F.lit(1)).alias("n_a"))
    hb = rb.join(tot, key_cols).groupBy(*key_cols).agg(
        (-F.sum(F.col("bj") / F.col("N") * F.log(F.col("bj") / F.col("N")))).alias("h_b"),
        F.sum(F.col("bj").cast("double") * (F.col("bj") - 1) / 2).alias("sum_b2"),
        F.count(F.lit(1)).alias("n_b"))
    emi = expected_mutual_information(ra, rb, tot, key_cols, a, b)
    s = mi.join(ha, key_cols).join(hb, key_cols).join(tot, key_cols).join(emi, key_cols)

    def avg(kind: str) -> Column:
        h_a, h_b = F.col("h_a"), F.col("h_b")
        return {"geometric": F.sqrt(h_a * h_b), "arithmetic": (h_a + h_b) / 2,
                "max": F.greatest(h_a, h_b), "min": F.least(h_a, h_b)}[kind]

    single = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    both_zero = (F.col("h_a") == 0) & (F.col("h_b") == 0)
    nmi = F.when(single | both_zero, F.lit(1.0)).otherwise(
        F.col("mi") / F.greatest(avg(nmi_average), F.lit(1e-300)))
    denom = avg(ami_average) - F.col("emi")
    ami = F.when(single | both_zero, F.lit(1.0)).otherwise(F.try_divide(F.col("mi") - F.col("emi"), denom))
    n_pairs = F.col("N").cast("double") * (F.col("N") - 1) / 2
    expected = F.col("sum_a2") * F.col("sum_b2") / n_pairs
    max_index = (F.col("sum_a2") + F.col("sum_b2")) / 2
    trivial = (F.col("n_a") == F.col("n_b")) & ((F.col("n_a") == 1) | (F.col("n_a") == F.col("N")))
    ari = F.when(trivial, F.lit(1.0)).otherwise(F.try_divide(F.col("sum_nij2") - expected, max_index - expected))
    return s.select(*key_cols, "mi", "h_a", "h_b", "emi", nmi.alias("nmi"), ami.alias("ami"), ari.alias("ari"))


EMI_BLOCK = 1024


def expected_mutual_information(ra: DataFrame, rb: DataFrame, tot: DataFrame, key_cols: list[str],
                                a: str, b: str) -> DataFrame:
    """E[MI] under the hypergeometric model of random labellings.

    For each (a_i, b_j) the sum runs over n_ij in [max(1, a+b-N), min(a, b)],
    in blocks of ``EMI_BLOCK`` counts, so that no row holds a long array. A
    block is left out only where Hoeffding's bound exp(-b KL(q/b, a/N)) on the
    probability of all counts from its near end q outward, times the greatest
    term ln N, is below 1e-40: less than one unit in the last place of E[MI],
    which is at least about 1/(2N). Probabilities are ratios of binomial ones
    in saddle-point form, so nothing of the size N ln N cancels.
    """
    pairs = ra.join(rb, key_cols).join(tot, key_cols)
    A, B, N = (F.col(c).cast("double") for c in ("ai", "bj", "N"))
    p, r = A / N, (N - A) / N
    lo = F.greatest(F.lit(1), F.col("ai") + F.col("bj") - F.col("N")).cast("bigint")
    hi = F.least(F.col("ai"), F.col("bj")).cast("bigint")
    blocks = pairs.withColumns({"_lo": lo, "_hi": hi}).where("_hi >= _lo").select(
        *key_cols, "ai", "bj", "N", "_lo", "_hi",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_hi") - F.col("_lo")) / EMI_BLOCK))).alias("_block"))
    first = F.col("_lo") + F.col("_block") * EMI_BLOCK
    last = F.least(F.col("_hi"), first + EMI_BLOCK - 1)
    near = F.when(first > A * B / N, first).when(last < A * B / N, last).cast("double")
    share, other = near / B, 1 - near / B
    kl = share * F.log(share / p) + F.when(other > 0, other * F.log(other / r)).otherwise(0.0)
    alive = near.isNull() | (F.log(F.log(N) + 1) - B * kl > math.log(1e-40)) | (r <= 0)
    steps = blocks.where(F.coalesce(alive, F.lit(True))).select(
        *key_cols, "ai", "bj", "N", F.explode(F.sequence(first, last)).alias("q"))
    q = F.col("q")
    split = F.col("bj") / N  # any split of the binomials gives the same ratio
    rest = 1 - split
    parts = F.array(*[F.struct(x.alias("x"), n.alias("n"), F.lit(sign).alias("sign")) for x, n, sign in (
        (q, F.col("ai"), 1.0), (F.col("bj") - q, F.col("N") - F.col("ai"), 1.0), (F.col("bj"), F.col("N"), -1.0))])
    ln_p = F.when(F.col("bj") == F.col("N"), F.lit(0.0)).otherwise(
        F.aggregate(parts, F.lit(0.0), lambda acc, s: acc + s["sign"] * ln_binomial(s["x"], s["n"], split, rest)))
    term = q.cast("double") / N * F.log(N * q / (A * B)) * F.exp(ln_p)
    emi = steps.groupBy(*key_cols).agg(F.sum(term).alias("emi"))
    return tot.select(*key_cols).join(emi, key_cols, "left").fillna(0.0, ["emi"])


def class_rankings(doc_terms: DataFrame, classes: DataFrame, vocab: DataFrame, top: int = -1) -> DataFrame:
    """F1 (first half): rankings of the class centroids (topic = class_idx)."""
    from .centroids import build_centroids
    from .rankings import rank_terms

    part = classes.select("doc_id", F.col("class_idx").alias("topic")).withColumn("_set", F.lit("classes"))
    cent = build_centroids(doc_terms, part, ["_set"])
    return rank_terms(cent, vocab, ["_set"], top=top).drop("_set")


def at_depths(rankings: DataFrame, tops) -> DataFrame:
    """Every ranking cut at each depth in ``tops``, with the depth as a
    key column ``top`` (one narrow explode; no pass per depth)."""
    depths = F.array(*[F.lit(int(t)) for t in tops])
    return rankings.select("*", F.explode(depths).alias("top")).where(F.col("rank") <= F.col("top"))


def term_agreement(class_rank: DataFrame, test_rankings: DataFrame, key_cols: list[str],
                   tops=(10, 20, 50, 100)) -> DataFrame:
    """agreement of each ranking set with the class rankings at each
    depth: key_cols + score ('terms-010', ...), value. All depths go
    through one similarity matrix and one matching job."""
    keys = [*key_cols, "top"]
    sims = class_similarity(at_depths(class_rank.select("topic", "rank", "term"), tops), at_depths(test_rankings, tops), ["top"], keys)
    agree = ranking_set_agreement(sims, keys)
    return agree.select(*key_cols, F.format_string("terms-%03d", F.col("top")).alias("score"),
                        F.col("agreement").alias("value"))


def class_similarity(classes: DataFrame, models: DataFrame, on: list[str], keys: list[str],
                     metric: str = "average_jaccard", classes_first: bool = True) -> DataFrame:
    """Similarity of the class rankings (``on`` + topic, rank, term) with the topics of every model (``keys``, which
    hold ``on``): the class rankings are packed to one array each and joined with the models' arrays on ``on``."""
    a = ranking_arrays(classes, on).select(*on, F.col("topic").alias("_class"), F.col("terms").alias("ta"))
    b = ranking_arrays(models, keys).select(*keys, F.col("topic").alias("_topic"), F.col("terms").alias("tb"))
    pairs = b.join(a, on)
    row, col = ("_class", "_topic") if classes_first else ("_topic", "_class")
    pairs = with_average_jaccard(pairs, "ta", "tb") if metric == "average_jaccard" else pairs.withColumn(
        "score", jaccard(F.col("ta"), F.col("tb")))
    return pairs.select(*keys, F.col(row).alias("row"), F.col(col).alias("col"), "score")


def topic_diversity(rankings: DataFrame, key_cols: list[str], tops=(10,)) -> DataFrame:
    """mean of 1 - AJ over unordered topic pairs (i < j) of each set, at
    each depth; null for a set of one topic."""
    keys = [*key_cols, "top"]
    arr = ranking_arrays(at_depths(rankings, tops), keys)
    x = arr.select(*keys, F.col("topic").alias("i"), F.col("terms").alias("ta"))
    y = arr.select(*keys, F.col("topic").alias("j"), F.col("terms").alias("tb"))
    pairs = with_average_jaccard(x.join(y, keys).where(F.col("i") < F.col("j")), "ta", "tb", "aj")
    div = pairs.groupBy(*keys).agg(F.avg(1 - F.col("aj")).alias("value"))
    sets = arr.select(*keys).distinct()
    return sets.join(div, keys, "left").select(
        *key_cols, F.format_string("div-%03d", F.col("top")).alias("score"), "value")


def aggregate_scores(scores: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """mean and population std of every score over the experiments."""
    g = list(group_cols or [])
    return scores.groupBy(*g, "score").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def score_table(scores: DataFrame, include_mean: bool = True) -> DataFrame:
    """experiments x scores, missing = 0.0, plus a MEAN row (mean of each
    score over the experiments that have it). Long form: experiment, score,
    value. The scores are written once, since three aggregates read them."""
    path = scratch_path(scores.sparkSession, "scores")
    scores.select("experiment", "score", "value").write.parquet(path)
    scores = scores.sparkSession.read.parquet(path)
    names = scores.agg(F.collect_set("score")).scalar()  # score names: one per metric and depth
    grid = scores.select("experiment").distinct().select("experiment", F.explode(names).alias("score"))
    filled = grid.join(scores, ["experiment", "score"], "left").select(
        "experiment", "score", F.coalesce("value", F.lit(0.0)).alias("value"))
    if not include_mean:
        return filled
    means = scores.groupBy("score").agg(F.avg("value").alias("value")).select(
        F.lit("MEAN").alias("experiment"), "score", "value")
    return filled.unionByName(means)


def upsert_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """F8: ``new`` scores (experiment, score, value) written over ``old`` ones: the last write of a name wins,
    everything else stays."""
    both = old.select("experiment", "score", "value", F.lit(0).alias("_turn")).unionByName(
        new.select("experiment", "score", "value", F.lit(1).alias("_turn")))
    return both.groupBy("experiment", "score").agg(F.max_by("value", "_turn").alias("value"))


def validate_partitions(pairs: DataFrame, key_cols: list[str], a: str = "class_idx", b: str = "topic") -> DataFrame:
    """``partition_scores`` of the models whose documents are in two classes or more; the others have no scores."""
    classes = pairs.groupBy(*key_cols).agg(F.countDistinct(a).alias("_classes")).where("_classes >= 2").drop("_classes")
    return partition_scores(pairs.join(classes, key_cols, "left_semi"), key_cols, a, b)
