"""Queries for ensembles (H) and validation (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble as en
from ..operators import rankings as rk
from ..operators import validation as va
from ..operators import vectorize as vz
from . import oracle_sql as O
from .catalog import MATRIX_CFG, corpus, i64, query, r6, table
from .queries_rank import (FLAG_KMAX, FLAG_KMIN, FLAG_RUNS, FLAG_TOP, REF_TST, class_fold_sql, fold_rankings,
                           lang_classes, lang_rank_sql)

# ---------------------------------------------------------------------------
# Ensembles: anchor = reference model of each k, members = its runs.
# ---------------------------------------------------------------------------


@query("relevance_scores", sql=f"""
WITH {class_fold_sql()}, n AS (SELECT max(rank) AS n FROM top_r)
SELECT CAST(r.range AS BIGINT) AS rank, 1.0 AS unit, round(1.0 / r.range, 6) AS reciprocal,
       round(1.0 / (ln(r.range + 1) / ln(2)), 6) AS log FROM n, range(1, n.n + 1) r""")
def q_relevance_scores(spark, sf_dir):
    """H1-H4: relevance of ranks 1..n (n = deepest rank of the sweep)."""
    _, r = fold_rankings(spark, sf_dir)
    t = en.relevance_table(r.agg(F.max("rank").alias("n")))
    return t.select(i64("rank").alias("rank"), r6("unit").alias("unit"), r6("reciprocal").alias("reciprocal"),
                    r6("log").alias("log"))


ENS_SQL = f"""{class_fold_sql()},
ew AS (SELECT k, topic, term, sum(1.0 / rank) AS weight FROM top_r WHERE run > 0 GROUP BY ALL),
er AS (SELECT k, topic, count(DISTINCT run) AS runs FROM top_r WHERE run > 0 GROUP BY ALL),
ens AS (SELECT ew.*, er.runs FROM ew JOIN er USING (k, topic))"""


def _ens(spark, sf_dir):
    _, r = fold_rankings(spark, sf_dir)
    runs = r.where(F.col("kind") == "run").select("k", "topic", F.col("run").cast("string").alias("member"),
                                                  "rank", "term")
    return r, en.ensemble_weights(runs, ["k", "topic"])


@query("ensemble_weights", sql=f"""
WITH {ENS_SQL}
SELECT CAST(k AS BIGINT) AS k, CAST(topic AS BIGINT) AS topic, term, round(weight, 6) AS weight,
       CAST(runs AS BIGINT) AS runs FROM ens""")
def q_ensemble_weights(spark, sf_dir):
    """H5: reciprocal-rank weight of each term over the runs, per (k, topic)."""
    _, w = _ens(spark, sf_dir)
    return w.select(i64("k").alias("k"), i64("topic").alias("topic"), "term", r6("weight").alias("weight"),
                    i64("runs").alias("runs"))


@query("ensemble_ranking", sql=f"""
WITH {ENS_SQL},
o AS (SELECT k, topic, term, weight, runs,
             row_number() OVER (PARTITION BY k, topic ORDER BY round(weight, 9) DESC, term) AS rank FROM ens)
SELECT CAST(k AS BIGINT) AS k, CAST(topic AS BIGINT) AS topic, CAST(rank AS BIGINT) AS rank,
       term || ' (' || CAST(CAST(round(CAST(round(weight / runs, 9) AS DECIMAL(38,9)), 2) AS DECIMAL(38,2)) AS VARCHAR) || ')' AS entry FROM o WHERE rank <= 10""")
def q_ensemble_ranking(spark, sf_dir):
    """Top 10 ensemble terms with their mean relevance."""
    _, w = _ens(spark, sf_dir)
    e = en.ensemble_ranking(w, ["k", "topic"], top=10, include_weights=True)
    return e.select(i64("k").alias("k"), i64("topic").alias("topic"), i64("rank").alias("rank"), "entry")


@query("ensemble_score", sql=f"""
WITH {ENS_SQL},
q AS (SELECT k, topic, term FROM top_r WHERE run = 0)
SELECT CAST(q.k AS BIGINT) AS k, CAST(q.topic AS BIGINT) AS topic, q.term,
       round(coalesce(e.weight / e.runs, 0.0), 6) AS score
FROM q LEFT JOIN ens e ON e.k = q.k AND e.topic = q.topic AND e.term = q.term""")
def q_ensemble_score(spark, sf_dir):
    """H7: ensemble score of the reference terms (0 when absent)."""
    r, w = _ens(spark, sf_dir)
    q = r.where(F.col("kind") == "reference").select("k", "topic", "term")
    s = en.ensemble_score(w, q, ["k", "topic"])
    return s.select(i64("k").alias("k"), i64("topic").alias("topic"), "term", r6("score").alias("score"))


@query("ensemble_terms", sql=f"""
WITH {ENS_SQL}
SELECT CAST(k AS BIGINT) AS k, CAST(topic AS BIGINT) AS topic, CAST(count(DISTINCT term) AS BIGINT) AS n_terms
FROM ens GROUP BY k, topic""")
def q_ensemble_terms(spark, sf_dir):
    """H8: distinct terms per ensemble ranking."""
    _, w = _ens(spark, sf_dir)
    t = en.ensemble_terms(w, ["k", "topic"])
    return t.select(i64("k").alias("k"), i64("topic").alias("topic"), i64("n_terms").alias("n_terms"))


def _topic_ens_sql(final: str) -> str:
    return f"""
WITH {class_fold_sql()}, {REF_TST}, {O.aj_ctes('ref', 'tst', ['run', 'k'])},
best AS (
  WITH RECURSIVE st(run, k, n, used, tot, path) AS (
    SELECT DISTINCT run, k, 0, CAST(0 AS BIGINT), CAST(0.0 AS DOUBLE), CAST([] AS INTEGER[]) FROM aj
    UNION ALL
    SELECT a.run, a.k, a.n + 1, a.used | (CAST(1 AS BIGINT) << s.col), a.tot + s.score, list_append(a.path, s.col)
    FROM st a JOIN aj s ON s.run = a.run AND s.k = a.k AND s.row = a.n
    WHERE (a.used & (CAST(1 AS BIGINT) << s.col)) = 0)
  SELECT run, k, arg_max(path, tot) AS path FROM st WHERE n = k GROUP BY run, k),
m AS (SELECT b.run, b.k, CAST(p.i - 1 AS INTEGER) AS row, p.c AS col
      FROM best b, LATERAL (SELECT unnest(b.path) AS c, unnest(range(1, len(b.path) + 1)) AS i) p),
ms AS (SELECT m.*, aj.score FROM m JOIN aj USING (run, k, row, col)),
moved AS (SELECT t.k, CAST(t.run AS VARCHAR) AS member, ms.row AS topic, t.rank, t.term
          FROM tst t JOIN ms ON ms.run = t.run AND ms.k = t.k AND ms.col = t.topic),
allr AS (SELECT k, '__anchor__' AS member, topic, rank, term FROM top_r WHERE run = 0 UNION ALL SELECT * FROM moved)
{final}"""


@query("topic_ensemble", sql=_topic_ens_sql("""
SELECT CAST(k AS BIGINT) AS k, CAST(topic AS BIGINT) AS topic, term, round(sum(1.0 / rank), 6) AS weight,
       CAST(any_value(runs) AS BIGINT) AS runs
FROM allr JOIN (SELECT k, topic, count(DISTINCT member) AS runs FROM allr GROUP BY ALL) USING (k, topic)
GROUP BY k, topic, term"""))
def q_topic_ensemble(spark, sf_dir):
    """H9: runs matched to the reference topics and pooled per anchor topic."""
    _, r = fold_rankings(spark, sf_dir)
    anchor = r.where(F.col("kind") == "reference").select("k", "topic", "rank", "term")
    others = r.where(F.col("kind") == "run").select("k", F.col("run").cast("string").alias("member"),
                                                    "topic", "rank", "term")
    w, _ = en.topic_ensemble(anchor, others, ["k"])
    return w.select(i64("k").alias("k"), i64("topic").alias("topic"), "term", r6("weight").alias("weight"),
                    i64("runs").alias("runs"))


@query("ensemble_consistency", sql=_topic_ens_sql("""
SELECT CAST(t.k AS BIGINT) AS k, CAST(t.topic AS BIGINT) AS topic, round(coalesce(sum(ms.score), 0.0), 6) AS consistency
FROM (SELECT DISTINCT k, topic FROM top_r WHERE run = 0) t LEFT JOIN ms ON ms.k = t.k AND ms.row = t.topic
GROUP BY t.k, t.topic"""))
def q_ensemble_consistency(spark, sf_dir):
    """Summed similarity of the runs matched to each anchor topic."""
    _, r = fold_rankings(spark, sf_dir)
    anchor = r.where(F.col("kind") == "reference").select("k", "topic", "rank", "term")
    others = r.where(F.col("kind") == "run").select("k", F.col("run").cast("string").alias("member"),
                                                    "topic", "rank", "term")
    _, c = en.topic_ensemble(anchor, others, ["k"])
    return c.select(i64("k").alias("k"), i64("topic").alias("topic"), r6("consistency").alias("consistency"))


# ---------------------------------------------------------------------------
# Validation
# ---------------------------------------------------------------------------

def _pair_sql(name: str) -> str:
    """(pair, doc_id, a, b): lang vs source over kept docs; quality vs toxic over labels."""
    return f"""{name} AS (
  SELECT 'lang~source' AS pair, doc_id, lang AS a, source AS b FROM documents
  UNION ALL
  SELECT 'quality~toxic', doc_id, CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR) FROM labels)"""


def _pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("lang~source").alias("pair"), "doc_id",
                                                  F.col("lang").alias("a"), F.col("source").alias("b"))
    l = table(spark, sf_dir, "labels").select(F.lit("quality~toxic").alias("pair"), "doc_id",
                                               F.col("quality").cast("string").alias("a"),
                                               F.col("toxic").cast("string").alias("b"))
    return d.unionByName(l)


PSCORE_SQL = """ct AS (SELECT pair, a, b, CAST(count(*) AS BIGINT) AS nij FROM pp GROUP BY ALL),
ra AS (SELECT pair, a, CAST(sum(nij) AS BIGINT) AS ai FROM ct GROUP BY ALL),
rb AS (SELECT pair, b, CAST(sum(nij) AS BIGINT) AS bj FROM ct GROUP BY ALL),
tt AS (SELECT pair, CAST(sum(nij) AS BIGINT) AS n FROM ct GROUP BY ALL),
mi AS (SELECT ct.pair, sum(nij / n * ln(n * nij / (ai * bj))) AS mi, sum(nij * (nij - 1) / 2.0) AS s_ij
       FROM ct JOIN ra USING (pair, a) JOIN rb USING (pair, b) JOIN tt USING (pair) GROUP BY ALL),
ha AS (SELECT pair, -sum(ai / n * ln(ai / n)) AS h_a, sum(ai * (ai - 1) / 2.0) AS s_a, count(*) AS n_a
       FROM ra JOIN tt USING (pair) GROUP BY ALL),
hb AS (SELECT pair, -sum(bj / n * ln(bj / n)) AS h_b, sum(bj * (bj - 1) / 2.0) AS s_b, count(*) AS n_b
       FROM rb JOIN tt USING (pair) GROUP BY ALL),
qq AS (SELECT ra.pair, ai, bj, n, unnest(range(greatest(1, ai + bj - n), least(ai, bj) + 1)) AS q
       FROM ra JOIN rb USING (pair) JOIN tt USING (pair)),
emi AS (SELECT pair, sum(q / n * ln(n * q / (ai * bj)) * exp(lgamma(ai + 1) + lgamma(bj + 1) + lgamma(n - ai + 1)
          + lgamma(n - bj + 1) - lgamma(n + 1) - lgamma(q + 1) - lgamma(ai - q + 1) - lgamma(bj - q + 1)
          - lgamma(n - ai - bj + q + 1))) AS emi FROM qq GROUP BY pair),
sc AS (SELECT pair, mi, h_a, h_b, coalesce(emi, 0.0) AS emi, s_ij, s_a, s_b, n_a, n_b, n
       FROM mi JOIN ha USING (pair) JOIN hb USING (pair) JOIN tt USING (pair) LEFT JOIN emi USING (pair)),
fin AS (SELECT pair,
  CASE WHEN (n_a = 1 AND n_b = 1) OR (h_a = 0 AND h_b = 0) THEN 1.0 ELSE mi / sqrt(h_a * h_b) END AS nmi,
  CASE WHEN (n_a = 1 AND n_b = 1) OR (h_a = 0 AND h_b = 0) THEN 1.0 ELSE (mi - emi) / (greatest(h_a, h_b) - emi) END AS ami,
  CASE WHEN n_a = n_b AND (n_a = 1 OR n_a = n) THEN 1.0
       ELSE (s_ij - s_a * s_b / (n * (n - 1) / 2.0)) / ((s_a + s_b) / 2 - s_a * s_b / (n * (n - 1) / 2.0)) END AS ari
  FROM sc)"""


@query("contingency", sql=f"""
WITH {_pair_sql('pp')}
SELECT pair, a, b, CAST(count(*) AS BIGINT) AS n FROM pp GROUP BY ALL""")
def q_contingency(spark, sf_dir):
    """class x cluster counts (lang x source, quality x toxic)."""
    c = va.contingency(_pairs(spark, sf_dir), ["pair"], "a", "b")
    return c.select("pair", "a", "b", i64("n").alias("n"))


def _score(spark, sf_dir, col):
    s = va.partition_scores(_pairs(spark, sf_dir), ["pair"], "a", "b")
    return s.select("pair", r6(col).alias(col))


for _m in ("nmi", "ami", "ari"):
    query(_m, sql=f"WITH {_pair_sql('pp')}, {PSCORE_SQL} SELECT pair, round({_m}, 6) AS {_m} FROM fin")(
        (lambda m: lambda spark, sf_dir: _score(spark, sf_dir, m))(_m))





def _fold_partition_sql() -> str:
    return f"""{O.docs_cte(label_col='source')}, {O.members_cte(FLAG_RUNS)}, {O.class_idx_cte()},
lc AS (SELECT d.doc_id, x.lang FROM docs d JOIN documents x USING (doc_id)),
pp AS (SELECT printf('k%02d_run%03d', k.range, m.run) AS pair, m.doc_id, lc.lang AS a,
              CAST(c.class_idx % k.range AS VARCHAR) AS b
       FROM members m JOIN cls c USING (doc_id) JOIN lc USING (doc_id), range({FLAG_KMIN}, {FLAG_KMAX} + 1) k)"""


def _fold_partition_scores(spark, sf_dir):
    from ..operators import centroids as ce
    from ..operators import sampling as sm
    docs = vz.document_list(table(spark, sf_dir, "documents"), label_col="source")
    cls = ce.class_partition(docs)
    mem = sm.run_members(docs.select("doc_id"), FLAG_RUNS, O.RATIO, O.SEED)
    lang = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("a"))
    ks = F.explode(F.sequence(F.lit(FLAG_KMIN), F.lit(FLAG_KMAX))).alias("k")
    pp = (mem.join(cls, "doc_id").join(lang, "doc_id").select("*", ks)
          .select(F.format_string("k%02d_run%03d", F.col("k"), F.col("run")).alias("pair"), "doc_id", "a",
                  F.pmod(F.col("class_idx"), F.col("k")).cast("string").alias("b"))).persist()
    return va.validate_partitions(pp, ["pair"], "a", "b")


@query("partition_scores", sql=f"""
WITH {_fold_partition_sql()}, {PSCORE_SQL}
SELECT pair AS experiment, round(nmi, 6) AS nmi, round(ami, 6) AS ami, round(ari, 6) AS ari FROM fin""")
def q_partition_scores(spark, sf_dir):
    """NMI / AMI / ARI of every sweep partition against the lang classes."""
    s = _fold_partition_scores(spark, sf_dir)
    return s.select(F.col("pair").alias("experiment"), r6("nmi").alias("nmi"), r6("ami").alias("ami"),
                    r6("ari").alias("ari"))


def _long_scores(spark, sf_dir):
    s = _fold_partition_scores(spark, sf_dir)
    return s.select(F.col("pair").alias("experiment"),
                    F.explode(F.array(*[F.struct(F.lit(f"external-{m}").alias("score"), F.col(m).alias("value"))
                                        for m in ("ami", "ari", "nmi")])).alias("s")).select(
        "experiment", "s.score", "s.value")


LONG_SQL = f"""{_fold_partition_sql()}, {PSCORE_SQL},
ls AS (SELECT pair AS experiment, 'external-nmi' AS score, nmi AS value FROM fin
       UNION ALL SELECT pair, 'external-ami', ami FROM fin UNION ALL SELECT pair, 'external-ari', ari FROM fin)"""


@query("aggregate_scores", sql=f"""
WITH {LONG_SQL}
SELECT score, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM ls GROUP BY score""")
def q_aggregate_scores(spark, sf_dir):
    """mean and population std of every score over the sweep."""
    a = va.aggregate_scores(_long_scores(spark, sf_dir))
    return a.select("score", r6("mean").alias("mean"), r6("std").alias("std"))


@query("score_table", sql=f"""
WITH {LONG_SQL}
SELECT experiment, score, round(value, 6) AS value FROM ls
UNION ALL SELECT 'MEAN', score, round(avg(value), 6) FROM ls GROUP BY score""")
def q_score_table(spark, sf_dir):
    """experiment x score table with a MEAN row (long form)."""
    t = va.score_table(_long_scores(spark, sf_dir))
    return t.select("experiment", "score", r6("value").alias("value"))


@query("topic_diversity", sql=f"""
WITH {class_fold_sql(top=10)},
a AS (SELECT run, k, topic, rank, term FROM top_r),
b AS (SELECT * FROM a),
{O.aj_ctes('a', 'b', ['run', 'k'])}
SELECT CAST(k AS BIGINT) AS k, CAST(run AS BIGINT) AS run, 'div-010' AS score, round(avg(1 - score), 6) AS value
FROM aj WHERE row < col GROUP BY k, run""")
def q_topic_diversity(spark, sf_dir):
    """mean pairwise (1 - Average Jaccard) of each model's topics at depth 10."""
    _, r = fold_rankings(spark, sf_dir, top=10)
    d = va.topic_diversity(r, ["algo", "kind", "k", "run"], tops=(10,))
    return d.select(i64("k").alias("k"), i64("run").alias("run"), "score", r6("value").alias("value"))


def _term_agree_sql() -> str:
    parts = []
    for top in (10, 20, 50, 100):
        parts.append(f"""t{top} AS (
  WITH a AS (SELECT run, k, topic, rank, term FROM top_r WHERE rank <= {top}),
  c AS (SELECT r.run, r.k, l.topic, l.rank, l.term FROM crk0 l, (SELECT DISTINCT run, k FROM top_r) r
        WHERE l.rank <= {top}),
  {O.aj_ctes('a', 'c', ['run', 'k'])},
  sim AS (SELECT run, k, CASE WHEN k <= 4 THEN row ELSE col END AS row,
                 CASE WHEN k <= 4 THEN col ELSE row END AS col, score FROM aj),
  {O.assignment_ctes('sim', ['run', 'k'])}
  SELECT run, k, 'terms-{top:03d}' AS score, total / pairs AS value FROM asg)""")
    return ",\n".join(parts)


@query("term_agreement", sql=f"""
WITH {class_fold_sql(top=100)}, {lang_rank_sql()}, {_term_agree_sql()}
SELECT CAST(k AS BIGINT) AS k, CAST(run AS BIGINT) AS run, score, round(value, 6) AS value FROM (
  SELECT * FROM t10 UNION ALL SELECT * FROM t20 UNION ALL SELECT * FROM t50 UNION ALL SELECT * FROM t100)""")
def q_term_agreement(spark, sf_dir):
    """agreement of every sweep model with the lang class rankings at 10/20/50/100."""
    c, r = fold_rankings(spark, sf_dir, top=100)
    cls = va.class_rankings(c.rows, lang_classes(spark, sf_dir, c), c.vocab, top=100)
    t = va.term_agreement(cls, r, ["algo", "kind", "k", "run"], tops=(10, 20, 50, 100))
    return t.select(i64("k").alias("k"), i64("run").alias("run"), "score", r6("value").alias("value"))


SUMMARY_SQL = f"""{class_fold_sql(top=100)}, {lang_rank_sql()}, {_term_agree_sql()},
{_fold_partition_sql().split("lc AS (", 1)[1].join(["lc AS (", ""])}, {PSCORE_SQL},
ls AS (SELECT pair AS experiment, 'external-nmi' AS score, nmi AS value FROM fin
       UNION ALL SELECT pair, 'external-ami', ami FROM fin UNION ALL SELECT pair, 'external-ari', ari FROM fin
       UNION ALL SELECT printf('k%02d_run%03d', k, run), score, value FROM (
         SELECT * FROM t10 UNION ALL SELECT * FROM t20 UNION ALL SELECT * FROM t50 UNION ALL SELECT * FROM t100))"""


def _all_scores(spark, sf_dir):
    """External and term scores of every sweep model: experiment, score, value."""
    c, r = fold_rankings(spark, sf_dir, top=100)
    cls = va.class_rankings(c.rows, lang_classes(spark, sf_dir, c), c.vocab, top=100)
    t = va.term_agreement(cls, r, ["algo", "kind", "k", "run"], tops=(10, 20, 50, 100))
    terms = t.select(F.format_string("k%02d_run%03d", F.col("k"), F.col("run")).alias("experiment"), "score", "value")
    return va.upsert_scores(_long_scores(spark, sf_dir), terms)


@query("validation_summary", sql=f"""
WITH {SUMMARY_SQL},
d AS (SELECT substr(experiment, 1, 3) AS experiment, score, avg(value) AS value FROM ls GROUP BY ALL)
SELECT experiment, score, round(value, 6) AS value FROM d
UNION ALL SELECT 'MEAN', score, round(avg(value), 6) FROM d GROUP BY score""")
def q_validation_summary(spark, sf_dir):
    """F8 + F11: external and term scores, per-k means over runs (one 'directory' per k), then the summary table."""
    s = _all_scores(spark, sf_dir).withColumn("experiment", F.substring("experiment", 1, 3))
    per_dir = va.aggregate_scores(s, ["experiment"]).select("experiment", "score", F.col("mean").alias("value"))
    t = va.score_table(per_dir)
    return t.select("experiment", "score", r6("value").alias("value"))
