"""Exact-size samples, E[MI] over its whole support, many centres, empty prototypes, re-ranking."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from quire.operators import kmeans as km
from quire.operators import lda as ld
from quire.operators import sampling as sm
from quire.operators.validation import expected_mutual_information


@pytest.mark.parametrize("n, ratio", [(1, 0.8), (37, 0.8), (500, 0.33), (50, 1.0), (50, 0.0)])
def test_samples_are_the_first_by_md5(spark, n, ratio):
    ids = spark.range(n).select(F.col("id").alias("doc_id"))
    got, out = ({(r["run"], r["doc_id"]) for r in sm.sample_runs(ids, 3, ratio, 7, complement=c).collect()} for c in (False, True))
    want = set()
    for run in (1, 2, 3):
        order = sorted(range(n), key=lambda d: hashlib.md5(f"7:{run}:{d}".encode()).hexdigest())
        want |= {(run, d) for d in order[:math.floor(ratio * n)]}
    assert got == want and not got & out and len(got | out) == 3 * n


def exact_emi(a, b, n):
    total = 0.0
    for x in a:
        for y in b:
            for q in range(max(1, x + y - n), min(x, y) + 1):
                ln = (math.lgamma(x + 1) + math.lgamma(y + 1) + math.lgamma(n - x + 1) + math.lgamma(n - y + 1) - math.lgamma(n + 1)
                      - math.lgamma(q + 1) - math.lgamma(x - q + 1) - math.lgamma(y - q + 1) - math.lgamma(n - x - y + q + 1))
                total += q / n * math.log(n * q / (x * y)) * math.exp(ln)
    return total


@pytest.mark.parametrize("a, b", [([5, 5], [3, 7]), ([1, 1, 1], [1, 1, 1]), ([10], [4, 6]), ([3000, 2000, 1], [2500, 2501]), ([40, 60], [99, 1])])
def test_expected_mutual_information(spark, a, b):
    n = sum(a)
    ra = spark.createDataFrame([("m", i, v) for i, v in enumerate(a)], "key string, a int, ai long")
    rb = spark.createDataFrame([("m", i, v) for i, v in enumerate(b)], "key string, b int, bj long")
    tot = spark.createDataFrame([("m", n)], "key string, N long")
    got = expected_mutual_information(ra, rb, tot, ["key"], "a", "b").first()["emi"]
    assert got == pytest.approx(exact_emi(a, b, n), rel=1e-9, abs=1e-13)


def test_distances_to_more_centres_than_a_block(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    centres = spark.range(600).select(F.col("id").cast("int").alias("topic"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    got = km.distances_to_centres(points, centres, "embedding", ("euclidean",))
    assert got.count() == 1200
    assert got.where("vec_id = 2 and topic = 599").first()["euclidean"] == pytest.approx(math.hypot(599, 1))


def test_empty_prototype_keeps_its_topic(spark):
    rows = spark.createDataFrame([(d, d % 2, 1.0) for d in range(6)], "doc_id long, term_idx int, weight double")
    members = spark.range(7).select(F.lit("m").alias("model"), F.col("id").alias("doc_id"))  # document 6 has no terms
    protos = spark.createDataFrame([("m", 0, 0), ("m", 1, 1), ("m", 6, 2)], "model string, doc_id long, topic int")
    init = km.prototype_centres(rows, protos, ["model"])
    _, assign, iters = km.kmeans(rows, members, init, ["model"], topics=protos)
    assert {r["doc_id"]: r["topic"] for r in assign.collect()} == {**{d: d % 2 for d in range(6)}, 6: 0}
    assert iters.count() == 1


def test_reranking(spark):
    weights = [("m", 0, 0, 4.0), ("m", 1, 0, 1.0), ("m", 0, 1, 3.0), ("m", 0, 2, 2.0), ("m", 1, 2, 0.0)]
    df = spark.createDataFrame(weights, "model string, topic int, term_idx int, weight double")
    got = {(r["topic"], r["term_idx"]): r["weight"] for r in ld.rerank(df, ["model"]).collect()}
    assert got == pytest.approx({(0, 0): 4 * math.log(2), (1, 0): math.log(0.5), (0, 1): 3.0, (0, 2): 2.0, (1, 2): 0.0})


def test_lda_recovers_blocks_and_reports_errors(spark):
    from test_models import KEYS, planted
    from quire.operators.validation import partition_scores
    from quire.sources import store

    c = planted(spark)
    members = sm.model_members(c.docs.select("doc_id"), "lda", 3, 3, 0).unionByName(
        sm.model_members(c.docs.select("doc_id"), "lda", 1, 1, 0)).unionByName(
        sm.model_members(c.docs.select((-F.col("doc_id") - 1).alias("doc_id")), "lda", 2, 2, 0))  # documents that have no terms
    counts = c.doc_terms.select("doc_id", "term_idx", F.col("tf").alias("count"))
    weights, parts, errors = ld.fit(counts, members, c.vocab, KEYS, max_iter=60, alpha=1.0)
    assert {r["k"]: r["error"] is None for r in errors.collect()} == {3: True, 1: True, 2: False}
    assert weights.where("k = 3").agg(F.sum("weight")).first()[0] == pytest.approx(3)
    truth = c.docs.select("doc_id", F.col("label").cast("int").alias("class_idx"))
    assert partition_scores(parts.where("k = 3").join(truth, "doc_id"), KEYS).first()["ari"] > 0.99
    assert store.lda_counts(c.doc_terms).where("count < 1").count() == 0


def test_lda_iterations_are_passes_over_all_documents(spark):
    counts = spark.createDataFrame([(i, i, 50) for i in range(40)], "doc_id long, term_idx int, count long")
    members = spark.createDataFrame([("lda", "sample", 2, 0, i) for i in range(40)], "algo string, kind string, k int, run int, doc_id long")
    for passes in (0, 1, 3):
        got = ld.topic_counts(counts, members, counts.select("term_idx"), ["algo", "kind", "k", "run"], max_iter=passes)
        per_term = got.groupBy("term_idx").agg(F.sum("count").alias("n")).collect()
        assert len(per_term) == 40 and all(abs(r["n"] - 50) < 1e-9 for r in per_term)


def test_scores_written_twice_keep_the_last(spark):
    from quire.operators import validation as va

    kind = "experiment string, score string, value double"
    old = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0)], kind)
    new = spark.createDataFrame([("a", "x", 3.0), ("b", "x", 5.0)], kind)
    got = va.upsert_scores(old, new)
    assert sorted(map(tuple, got.collect())) == [("a", "x", 3.0), ("a", "y", 2.0), ("b", "x", 5.0)]
    table = va.score_table(got)
    assert sorted(map(tuple, table.collect())) == [
        ("MEAN", "x", 4.0), ("MEAN", "y", 2.0), ("a", "x", 3.0), ("a", "y", 2.0), ("b", "x", 5.0), ("b", "y", 0.0)]


def test_one_class_has_no_scores(spark):
    from quire.operators import validation as va

    rows = [("m", 0, t % 2) for t in range(4)] + [("n", t % 2, t % 2) for t in range(4)]
    df = spark.createDataFrame(rows, "model string, class_idx int, topic int")
    assert [r["model"] for r in va.validate_partitions(df, ["model"]).collect()] == ["n"]
