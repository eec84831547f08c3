"""Queries for reference models: NMF from its NNDSVD start, spectral spherical k-means."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nmf as nm
from ..operators import sampling as sm
from ..operators import spectral as sp
from . import oracle_sql as O
from .catalog import MATRIX_CFG, corpus, i64, query

KEYS = ["algo", "kind", "k", "run"]
KMIN, KMAX = 2, 3


@query("reference_models", sql=f"""
WITH {O.docs_cte()}
SELECT 'nmf' AS algo, CAST(k.range AS BIGINT) AS k, (SELECT count(*) FROM docs) AS n_docs, true AS in_range,
       true AS converging, CAST(NULL AS VARCHAR) AS error
FROM range({KMIN}, {KMAX} + 1) k""")
def q_reference_models(spark, sf_dir):
    """D2 + D19: one NMF reference model per k on all documents, from the NNDSVD start: documents with a topic of the
    model, and whether the objective is below that of no topics at all."""
    c = corpus(spark, sf_dir, label_col="lang", cfg=MATRIX_CFG).settle()
    rows = c.sampled(0, O.RATIO, O.SEED)  # run 0 alone: all documents
    mem = sm.run_row_members(rows, "nmf", KMIN, KMAX)
    W, _, errors = nm.fit_rows(rows, mem, c.vocab, KEYS, max_iter=20, seed=O.SEED, start="nndsvd")
    part = nm.argmax_partition(W, KEYS).groupBy(*KEYS).agg(
        F.countDistinct("doc_id").alias("n_docs"), F.every((F.col("topic") >= 0) & (F.col("topic") < F.col("k"))).alias("in_range"))
    square = c.cells().agg(F.sum(F.col("weight") * F.col("weight"))).scalar()
    return errors.join(part, KEYS).select("algo", i64("k").alias("k"), i64("n_docs").alias("n_docs"), "in_range",
                                          (F.col("error") < square).alias("converging"), F.lit(None).cast("string").alias("error"))


@query("skm_reference", sql=f"""
WITH {O.docs_cte()}
SELECT CAST({KMAX} AS BIGINT) AS k, (SELECT count(*) FROM docs) AS n_docs, true AS in_range, true AS has_centroids""")
def q_skm_reference(spark, sf_dir):
    """D16 + D17: spectral spherical k-means on all documents: documents with a topic, centroids of all used topics."""
    c = corpus(spark, sf_dir, label_col="lang", cfg=MATRIX_CFG).settle()
    centroids, part = sp.spectral_kmeans(c.rows, None, c.vocab.count(), KMAX, O.SEED)
    used = part.select("topic").distinct()
    missing = used.join(centroids.select("topic").distinct(), "topic", "left_anti").agg(F.count(F.lit(1))).scalar()
    return part.groupBy("k").agg(F.countDistinct("doc_id").alias("n_docs"),
                                 F.every((F.col("topic") >= 0) & (F.col("topic") < F.col("k"))).alias("in_range")).select(
        i64("k").alias("k"), i64("n_docs").alias("n_docs"), "in_range", (missing == 0).alias("has_centroids"))
