"""Golden values: assignment totals, Average Jaccard, partition scores."""

import itertools
import math

import numpy as np
import pytest

from quire.operators.matching import max_similarity_assignment, min_cost_assignment

# Two self-check matrices and their totals.
PROFIT_6 = np.array([
    [62, 75, 80, 93, 95, 97],
    [75, 80, 82, 85, 71, 97],
    [80, 75, 81, 98, 90, 97],
    [78, 82, 84, 80, 50, 98],
    [90, 85, 85, 80, 85, 99],
    [65, 75, 80, 75, 68, 96],
])
COST_3 = np.array([[4, 2, 8], [4, 3, 7], [3, 1, 6]])


def total(m, pairs):
    return sum(m[r, c] for r, c in pairs)


def test_profit_matrix_total():
    assert total(PROFIT_6, max_similarity_assignment(PROFIT_6)) == 543


def test_cost_matrix_total():
    assert total(COST_3, min_cost_assignment(COST_3)) == 12


@pytest.mark.parametrize("seed", range(40))
def test_assignment_matches_enumeration(seed):
    rng = np.random.default_rng(seed)
    n, m = int(rng.integers(1, 6)), int(rng.integers(1, 6))
    s = rng.random((n, m)).round(2)
    pairs = max_similarity_assignment(s)
    assert len(pairs) == min(n, m)
    if n <= m:
        best = max(sum(s[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
    else:
        best = max(sum(s[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
    assert math.isclose(total(s, pairs), best, abs_tol=1e-9)


def test_average_jaccard_golden(spark):
    from pyspark.sql import functions as F

    from quire.operators.rankings import with_average_jaccard

    rows = [("album music best award win".split(), "sport best win medal award".split(), 0.15428571428571428),
            ("a b c d".split(), "a b d c".split(), 0.875),
            ("a b".split(), "a b c".split(), 1.0)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, want double")
    out = with_average_jaccard(df, "a", "b").collect()
    for r in out:
        assert math.isclose(r["score"], r["want"], rel_tol=1e-12)
    # symmetric
    sym = with_average_jaccard(df.select(F.col("b").alias("a"), F.col("a").alias("b"), "want"), "a", "b").collect()
    for r in sym:
        assert math.isclose(r["score"], r["want"], rel_tol=1e-12)


def test_partition_scores_golden(spark):
    from quire.operators.validation import partition_scores

    classes = [0, 0, 0, 1, 1, 1]
    clusters = [0, 0, 1, 1, 2, 2]
    df = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(zip(classes, clusters))],
                               "m int, doc_id int, class_idx int, topic int")
    r = partition_scores(df, ["m"]).first()
    assert math.isclose(r["mi"], 0.4620981204, abs_tol=1e-9)
    assert math.isclose(r["emi"], 0.2772588722, abs_tol=1e-9)
    assert math.isclose(r["nmi"], 0.5295405781, abs_tol=1e-9)
    assert math.isclose(r["ami"], 0.2250422832, abs_tol=1e-9)
    assert math.isclose(r["ari"], 0.2424242424, abs_tol=1e-9)
    r2 = partition_scores(df, ["m"], nmi_average="arithmetic", ami_average="arithmetic").first()
    assert math.isclose(r2["nmi"], 0.5158037430, abs_tol=1e-9)
    assert math.isclose(r2["ami"], 0.2987924582, abs_tol=1e-9)


def test_partition_scores_relabel_invariant(spark):
    from quire.operators.validation import partition_scores

    rows = [(1, i, a, b) for i, (a, b) in enumerate(zip([0, 0, 1, 1, 2, 2, 2], [1, 1, 0, 0, 2, 2, 0]))]
    rows += [(2, i, a, (b + 1) % 3) for (_, i, a, b) in rows]
    df = spark.createDataFrame(rows, "m int, doc_id int, class_idx int, topic int")
    out = {r["m"]: r for r in partition_scores(df, ["m"]).collect()}
    for c in ("nmi", "ami", "ari"):
        assert math.isclose(out[1][c], out[2][c], abs_tol=1e-12)
