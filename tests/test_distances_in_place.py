"""Distances to class centroids: rows read as they stand, centroids worked out once, counted documents given up."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import planted

from quire.operators import kmeans as km
from quire.operators.centroids import build_centroids, class_partition
from quire.plans import queries_models as qm


def _size(folders):
    from pathlib import Path

    return [sum(f.stat().st_size for f in Path(p.removeprefix("file:")).rglob("part-*")) for p in folders]


def test_rows_as_they_stand_give_the_same_centroids_and_distances(spark):
    c = planted(spark, blocks=3, per_block=8)
    part = class_partition(c.docs).select(F.lit("m").alias("model"), "doc_id", F.col("class_idx").alias("topic"))
    want = build_centroids(c.rows, part, ["model"])
    rows = class_partition(c.rows, kept=("terms", "weights")).select(F.lit("m").alias("model"), "doc_id", F.col("class_idx").alias("topic"), "terms", "weights")
    got = build_centroids(rows, None, ["model"])
    assert "Exchange hashpartitioning(doc_id" not in got._jdf.queryExecution().executedPlan().toString()
    flat = [{(r["topic"], r["term_idx"]): r["weight"] for r in x.collect()} for x in (want, got)]
    assert flat[0] == pytest.approx(flat[1])
    both = [{(r["doc_id"], r["topic"]): [r[m] for m in km.SPARSE_METRICS] for r in km.sparse_distances(
        c.rows, members, want, ["model"], terms=terms).collect()} for members, terms in ((part, None), (None, 18))]
    assert len(both[0]) == 72 and both[0].keys() == both[1].keys()
    assert all(np.allclose(both[0][i], both[1][i]) for i in both[0])


def test_query_packs_nothing_reads_documents_once_for_the_centroids_and_keeps_one_copy(spark, monkeypatch):
    c = planted(spark, blocks=3, per_block=8)
    monkeypatch.setattr(qm, "corpus", lambda *a, **more: c)
    monkeypatch.setattr(km, "pack", lambda *a: 1 / 0)
    counted = list(c.held)[:1]
    assert _size(counted) > [0]
    got = qm.q_sparse_distances(spark, "").collect()
    assert len(got) == 72 and _size(counted) == [0]
    assert sorted(map(tuple, c.docs.collect())) == sorted((b * 100 + d, str(b)) for b in range(3) for d in range(8))


def test_documents_without_label_or_terms_have_distances(spark):
    rows = spark.createDataFrame([(1, "a", [0, 2], [0.6, 0.8]), (2, "a", [1], [1.0]), (3, None, [2], [1.0]), (4, "b", [], [])],
                                 "doc_id long, label string, terms array<int>, weights array<double>")
    part = class_partition(rows, kept=("terms", "weights")).where("class_idx >= 0").select(
        F.lit("m").alias("model"), "doc_id", F.col("class_idx").alias("topic"), "terms", "weights")
    got = {(r["doc_id"], r["topic"]): r for r in km.sparse_distances(rows, None, build_centroids(part, None, ["model"]), ["model"], terms=3).collect()}
    assert set(got) == {(d, 0) for d in (1, 2, 3, 4)}  # class b has no terms and so no centre
    centre = np.array([0.3, 0.5, 0.4])
    for d, x in ((1, [0.6, 0, 0.8]), (2, [0, 1, 0]), (3, [0, 0, 1]), (4, [0, 0, 0])):
        gap = np.abs(np.array(x) - centre)
        assert got[d, 0]["euclidean"] == pytest.approx(np.linalg.norm(gap)) and got[d, 0]["chebyshev"] == pytest.approx(gap.max())
