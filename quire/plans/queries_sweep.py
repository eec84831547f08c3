"""One query for the sweep of all algorithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sweep as sw
from ..session import scratch_path
from . import oracle_sql as O
from .catalog import MATRIX_CFG, corpus, i64, query

KMIN, KMAX, RUNS, ITERATIONS, TOP = 2, 3, 1, 2, 10


@query("run_models", sql=f"""
WITH {O.matrix_ctes()}, {O.members_cte(RUNS)},
algos AS (SELECT unnest(['lda', 'nmf', 'skm']) AS algo)
SELECT algo, CAST(k.range AS BIGINT) AS k, CAST(m.run AS BIGINT) AS run, 'done' AS state, CAST({RUNS + 1} AS BIGINT) AS n_models,
       CAST(count(*) AS BIGINT) AS n_docs, true AS in_range, CAST(k.range * {TOP} AS BIGINT) AS n_ranked
FROM algos, range({KMIN}, {KMAX} + 1) k, members m GROUP BY ALL""")
def q_run_models(spark, sf_dir):
    """NMF, LDA and spherical k-means for k=2..3, reference and a run, in two goes of one folder: what the first wrote is
    not fitted again. Documents, topics and ranked terms of every model."""
    c = corpus(spark, sf_dir, label_col="lang", cfg=MATRIX_CFG)
    folder = scratch_path(spark, "sweep")
    sweeps = {a: sw.Sweep(KMIN, KMAX, RUNS, ITERATIONS, O.RATIO, O.SEED, TOP) for a in sw.FITTERS}
    sw.run_models(c, folder, {"nmf": sweeps["nmf"]})
    manifest = sw.run_models(c, folder, sweeps)
    parts = sw.load(spark, folder, "partitions").groupBy("algo", "k", "run").agg(
        i64(F.count(F.lit(1))).alias("n_docs"), F.every((F.col("topic") >= 0) & (F.col("topic") < F.col("k"))).alias("in_range"))
    ranked = sw.load(spark, folder, "rankings").groupBy("algo", "k", "run").agg(i64(F.count(F.lit(1))).alias("n_ranked"))
    out = parts.join(ranked, ["algo", "k", "run"]).join(F.broadcast(manifest), ["algo", "k"])  # a line for each algorithm and k
    return out.select("algo", i64("k").alias("k"), i64("run").alias("run"), "state", "n_models", "n_docs", "in_range", "n_ranked")
