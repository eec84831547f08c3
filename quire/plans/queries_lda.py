"""Queries for latent Dirichlet allocation and term re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lda as ld
from ..operators import rankings as rk
from ..operators import sampling as sm
from ..sources import store
from . import oracle_sql as O
from .catalog import COUNT_CFG, MATRIX_CFG, corpus, i64, query, r6

KEYS = ["algo", "kind", "k", "run"]
KMIN, KMAX, RUNS, TOP = 2, 3, 1, 10


def _sweep(spark, sf_dir):
    """The sweep with all iterations of the sampler, those that estimate the document prior among them."""
    c = corpus(spark, sf_dir, label_col="lang", cfg=MATRIX_CFG).settle()
    rows = c.sampled(RUNS, O.RATIO, O.SEED)
    mem = sm.run_row_members(rows, "lda", KMIN, KMAX)
    return c, mem, ld.fit(store.lda_counts(rows), mem, c.vocab, KEYS, max_iter=ld.SWEEP_ITERATIONS, seed=O.SEED)


STEP_K = 3


def _step_sql(sweeps: int) -> str:
    """Topic-term counts after the start and one iteration of the reference model of k = STEP_K."""
    start = f"(('0x' || substr(md5(concat_ws(':', '{O.SEED}', 'lda', 'reference', {STEP_K}, 0, d.doc_id)), 1, 8))::BIGINT % {STEP_K})"
    out = f"""WITH {O.matrix_ctes()},
x AS MATERIALIZED (SELECT doc_id, term_idx, greatest(1, floor(weight))::DOUBLE AS c FROM dt),
s AS (SELECT doc_id, {start} AS topic FROM docs d),
topics AS (SELECT range AS t FROM range({STEP_K})),
v AS (SELECT count(*) AS n FROM vocab),
n0 AS (SELECT term_idx, topic AS t, sum(c) AS n FROM x JOIN s USING (doc_id) GROUP BY ALL),
m0 AS (SELECT t, sum(n) AS n FROM n0 GROUP BY t),
phi AS (SELECT vocab.term_idx, t.t, (coalesce(n0.n, 0) + 0.01) / (coalesce(m0.n, 0) + v.n * 0.01) AS p
        FROM vocab CROSS JOIN topics t CROSS JOIN v LEFT JOIN n0 USING (term_idx, t) LEFT JOIN m0 USING (t)),
g0 AS (SELECT doc_id, term_idx, t, c, p, 1.0::DOUBLE / {STEP_K} AS g FROM x JOIN phi USING (term_idx))"""
    for i in range(1, sweeps + 1):
        out += f""",
e{i} AS (SELECT doc_id, t, sum(c * g) AS e FROM g{i - 1} GROUP BY ALL),
h{i} AS (SELECT doc_id, term_idx, t, c, p, (e - g + {10.0 / STEP_K!r}) * p AS h FROM g{i - 1} JOIN e{i} USING (doc_id, t)),
g{i} AS MATERIALIZED (SELECT doc_id, term_idx, t, c, p, h / sum(h) OVER (PARTITION BY doc_id, term_idx) AS g FROM h{i})"""
    return out + f"""
SELECT CAST(t AS BIGINT) AS topic, CAST(term_idx AS BIGINT) AS term_idx, round(sum(c * g), 6) + 0.0 AS n FROM g{sweeps} GROUP BY ALL"""


@query("lda_step", sql=_step_sql(ld.SWEEPS))
def q_lda_step(spark, sf_dir):
    """D6 (the start and one iteration, k=3): expected topic counts of every term."""
    c = corpus(spark, sf_dir, label_col="lang", cfg=MATRIX_CFG)
    mem = sm.model_members(c.docs.select("doc_id"), "lda", STEP_K, STEP_K, 0, O.RATIO, O.SEED)
    n = ld.topic_counts(store.lda_counts(c.rows), mem, c.vocab, KEYS, max_iter=1, seed=O.SEED)
    return n.select(i64("topic").alias("topic"), i64("term_idx").alias("term_idx"), r6("count").alias("n"))


GRID = f"""WITH {O.matrix_ctes()}, {O.members_cte(RUNS)},
grid AS (SELECT CAST(k.range AS BIGINT) AS k, r.run FROM range({KMIN}, {KMAX} + 1) k, (SELECT DISTINCT run FROM members) r),
used AS (SELECT m.run, count(*) AS n_docs FROM members m WHERE m.doc_id IN (SELECT doc_id FROM dt) GROUP BY m.run)"""


@query("lda_fit", sql=GRID + """
SELECT g.k, CAST(g.run AS BIGINT) AS run, CAST(g.k AS BIGINT) AS n_topics, (SELECT count(*) FROM vocab) AS n_terms,
       CAST(g.k AS DOUBLE) AS total_weight, CAST(NULL AS VARCHAR) AS error
FROM grid g""")
def q_lda_fit(spark, sf_dir):
    """D6 + D20: topics, terms and total weight (1 a topic) of each LDA model, and its error if any."""
    _, _, (weights, _, errors) = _sweep(spark, sf_dir)
    per = weights.groupBy(*KEYS).agg(F.countDistinct("topic").alias("n_topics"), F.countDistinct("term_idx").alias("n_terms"),
                                     F.sum("weight").alias("total_weight"))
    return errors.join(per, KEYS, "left").select(i64("k").alias("k"), i64("run").alias("run"), i64("n_topics").alias("n_topics"),
                                                 i64("n_terms").alias("n_terms"), r6("total_weight").alias("total_weight"), "error")


@query("lda_topics", sql=GRID + f"""
SELECT g.k, CAST(g.run AS BIGINT) AS run, CAST(t.range AS BIGINT) AS topic,
       least({TOP}, (SELECT count(*) FROM vocab)) AS n_terms, true AS falling
FROM grid g, range(0, {KMAX}) t WHERE t.range < g.k""")
def q_lda_topics(spark, sf_dir):
    """D7 + D8: the length of each topic's ranking and whether its weights fall."""
    c, _, (weights, _, _) = _sweep(spark, sf_dir)
    r = rk.rank_terms(weights, c.vocab, KEYS, top=TOP)
    falls = F.array_sort(F.collect_list(F.struct("rank", F.round("weight", 9).alias("w"))))
    per = r.groupBy(*KEYS, "topic").agg(F.count(F.lit(1)).alias("n_terms"), F.transform(falls, lambda x: x["w"]).alias("w"))
    ordered = F.forall(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.get("w", i - 1) >= F.get("w", i))
    return per.select(i64("k").alias("k"), i64("run").alias("run"), i64("topic").alias("topic"), i64("n_terms").alias("n_terms"),
                      ordered.alias("falling"))


@query("lda_partition", sql=GRID + """
SELECT g.k, CAST(g.run AS BIGINT) AS run, u.n_docs, u.n_docs AS n_ids, true AS in_range
FROM grid g JOIN used u ON u.run = g.run""")
def q_lda_partition(spark, sf_dir):
    """Documents of each model, each with one topic of the model."""
    _, _, (_, parts, _) = _sweep(spark, sf_dir)
    return parts.groupBy("k", "run").agg(
        F.count(F.lit(1)).alias("n_docs"), F.countDistinct("doc_id").alias("n_ids"),
        F.every((F.col("topic") >= 0) & (F.col("topic") < F.col("k"))).alias("in_range")).select(
        i64("k").alias("k"), i64("run").alias("run"), i64("n_docs").alias("n_docs"), i64("n_ids").alias("n_ids"), "in_range")


@query("rerank_terms", sql=f"""
WITH {O.matrix_ctes(tfidf=False, norm=False)}, {O.class_idx_cte()},
ct AS (SELECT c.class_idx, dt.term_idx, sum(dt.tf) AS n FROM dt JOIN cls c USING (doc_id) GROUP BY ALL),
w AS (SELECT k.class_idx AS topic, v.term_idx, v.term, coalesce(ct.n, 0) + 0.01::DOUBLE AS weight
      FROM (SELECT DISTINCT class_idx FROM cls) k CROSS JOIN vocab v
      LEFT JOIN ct ON ct.class_idx = k.class_idx AND ct.term_idx = v.term_idx),
g AS (SELECT *, exp(avg(ln(weight)) OVER (PARTITION BY term_idx)) AS g FROM w),
n AS (SELECT topic, term, CASE WHEN g > 1e-9 AND weight > 1e-9 THEN weight * ln(weight / g) ELSE weight END AS weight FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS rank FROM n)
SELECT CAST(topic AS BIGINT) AS topic, CAST(rank AS BIGINT) AS rank, term, round(weight, 6) AS weight FROM r WHERE rank <= 20""")
def q_rerank_terms(spark, sf_dir):
    """Top 20 re-ranked terms of each language, from its term counts + 0.01."""
    from ..operators.centroids import class_partition
    from ..operators.packed import explode_rows

    c = corpus(spark, sf_dir, label_col="lang", cfg=COUNT_CFG)
    classes = class_partition(c.docs).where("class_idx >= 0")
    counts = explode_rows(c.rows.select("doc_id", "terms", "tfs").join(classes, "doc_id"), ["class_idx"], {"terms": "term_idx", "tfs": "tf"}).groupBy("class_idx", "term_idx").agg(F.sum("tf").alias("n"))
    ids = classes.agg(F.collect_set("class_idx")).scalar()  # one number per class
    dense = c.vocab.select("term_idx", F.explode(ids).alias("class_idx")).join(counts, ["class_idx", "term_idx"], "left")
    weights = dense.select(F.lit("counts").alias("set"), F.col("class_idx").alias("topic"), "term_idx",
                           (F.coalesce("n", F.lit(0)) + F.lit(0.01)).cast("double").alias("weight"))
    r = rk.rank_terms(ld.rerank(weights, ["set"]), c.vocab, ["set"], top=20)
    return r.select(i64("topic").alias("topic"), i64("rank").alias("rank"), "term", r6("weight").alias("weight"))
