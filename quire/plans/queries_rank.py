"""Queries for rankings, agreement and stability (D4, D18, G, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stability as st
from ..plans import partition_stability as ps
from . import oracle_sql as O
from .catalog import MATRIX_CFG, corpus, i64, query, r6

FLAG_KMIN, FLAG_KMAX, FLAG_RUNS, FLAG_TOP = 2, 5, 10, 20


def class_fold_sql(kmin: int = FLAG_KMIN, kmax: int = FLAG_KMAX, runs: int = FLAG_RUNS,
                   top: int = FLAG_TOP, label_col: str = "source") -> str:
    """CTEs up to `top_r` (run, k, topic, rank, term, w): centroid rankings of
    the class-fold models."""
    return f"""{O.matrix_ctes(label_col=label_col)},
{O.members_cte(runs)},
{O.class_idx_cte()},
mc AS (SELECT m.run, m.doc_id, c.class_idx FROM members m JOIN cls c USING (doc_id)),
ks AS (SELECT CAST(range AS INTEGER) AS k FROM range({kmin}, {kmax} + 1)),
sums AS (SELECT mc.run, ks.k, mc.class_idx % ks.k AS topic, dt.term_idx, sum(dt.weight) AS s
         FROM dt JOIN mc USING (doc_id) CROSS JOIN ks GROUP BY ALL),
sizes AS (SELECT mc.run, ks.k, mc.class_idx % ks.k AS topic, count(*) AS n FROM mc CROSS JOIN ks GROUP BY ALL),
cent AS (SELECT s.run, s.k, s.topic, s.term_idx, s.s / z.n AS w FROM sums s JOIN sizes z USING (run, k, topic)),
rk AS (SELECT c.run, c.k, c.topic, v.term, c.w,
              row_number() OVER (PARTITION BY c.run, c.k, c.topic ORDER BY round(c.w, 9) DESC, v.term) AS rank
       FROM cent c JOIN vocab v USING (term_idx)),
top_r AS (SELECT * FROM rk WHERE rank <= {top})"""


def stability_sql(kmin: int = FLAG_KMIN, kmax: int = FLAG_KMAX, runs: int = FLAG_RUNS,
                  top: int = FLAG_TOP) -> str:
    return f"""
WITH {class_fold_sql(kmin, kmax, runs, top)},
ref AS (SELECT r.run, t.k, t.topic, t.rank, t.term
        FROM top_r t JOIN (SELECT DISTINCT run, k FROM top_r WHERE run > 0) r ON r.k = t.k WHERE t.run = 0),
tst AS (SELECT run, k, topic, rank, term FROM top_r WHERE run > 0),
{O.aj_ctes('ref', 'tst', ['run', 'k'])},
{O.assignment_ctes('aj', ['run', 'k'])}
SELECT 'class' AS algo, CAST(k AS BIGINT) AS k, round(avg(total / pairs), 6) AS stability,
       round(min(total / pairs), 6) AS min_agreement, round(max(total / pairs), 6) AS max_agreement,
       CAST(count(*) AS BIGINT) AS n_runs
FROM asg GROUP BY k"""


def flagship(spark, sf_dir):
    c = corpus(spark, sf_dir, label_col="source", cfg=MATRIX_CFG)
    stab = ps.partition_stability(c, FLAG_KMIN, FLAG_KMAX, FLAG_RUNS, FLAG_TOP, O.RATIO, O.SEED)
    return stab.select("algo", i64("k").alias("k"), r6("stability").alias("stability"),
                       r6("min_agreement").alias("min_agreement"), r6("max_agreement").alias("max_agreement"),
                       i64("n_runs").alias("n_runs"))


query("stability_by_k", sql=stability_sql())(flagship)


# ---------------------------------------------------------------------------
# Shared pieces: the flagship's class-fold models and the lang class rankings.
# ---------------------------------------------------------------------------
from ..operators import centroids as ce  # noqa: E402
from ..operators import ensemble as en  # noqa: E402
from ..operators import matching as mt  # noqa: E402
from ..operators import rankings as rk  # noqa: E402
from ..operators import sampling as sm  # noqa: E402
from ..operators import validation as va  # noqa: E402
from .catalog import table  # noqa: E402


def fold_rankings(spark, sf_dir, top=FLAG_TOP):
    c = corpus(spark, sf_dir, label_col="source", cfg=MATRIX_CFG)
    return c, ps.class_fold_rankings(c, FLAG_KMIN, FLAG_KMAX, FLAG_RUNS, top, O.RATIO, O.SEED)


def lang_classes(spark, sf_dir, c):
    docs = c.docs.select("doc_id").join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label")),
                                        "doc_id")
    return ce.class_partition(docs)


LANG_CLS_SQL = """lcls AS (SELECT d.doc_id, CAST(dense_rank() OVER (ORDER BY x.lang) - 1 AS INTEGER) AS class_idx
                  FROM docs d JOIN documents x USING (doc_id))"""


def lang_rank_sql(top: int | None = None) -> str:
    cut = f"WHERE rank <= {top}" if top else ""
    return f"""{LANG_CLS_SQL},
csum AS (SELECT c.class_idx AS topic, dt.term_idx, sum(dt.weight) AS s FROM dt JOIN lcls c USING (doc_id) GROUP BY ALL),
csize AS (SELECT class_idx AS topic, count(*) AS n FROM lcls GROUP BY ALL),
ccent AS (SELECT topic, term_idx, s / n AS w FROM csum JOIN csize USING (topic)),
crk0 AS (SELECT topic, v.term, w, row_number() OVER (PARTITION BY topic ORDER BY round(w, 9) DESC, v.term) AS rank
         FROM ccent JOIN vocab v USING (term_idx)),
crk AS (SELECT * FROM crk0 {cut})"""


KEYS = ["algo", "kind", "k", "run"]


@query("sample_runs", sql=f"""
WITH {O.docs_cte()}, {O.members_cte(FLAG_RUNS)}
SELECT CAST(run AS BIGINT) AS run, CAST(doc_id AS BIGINT) AS doc_id FROM members WHERE run > 0""")
def q_sample_runs(spark, sf_dir):
    """Exact-size md5 samples of the kept documents, one per run."""
    from ..operators import vectorize as vz
    docs = vz.prepare_documents(table(spark, sf_dir, "documents"))
    s = sm.sample_runs(docs.select("doc_id"), FLAG_RUNS, O.RATIO, O.SEED)
    return s.select(i64("run").alias("run"), i64("doc_id").alias("doc_id"))


@query("model_grid", sql=f"""
WITH {O.docs_cte()}, n AS (SELECT count(*) AS n FROM docs)
SELECT 'nmf' AS algo, kind, CAST(k AS BIGINT) AS k, CAST(run AS BIGINT) AS run, CAST({O.SEED} AS BIGINT) AS seed,
       CAST(CASE WHEN run = 0 THEN n ELSE floor({O.RATIO}::DOUBLE * n) END AS BIGINT) AS n_docs
FROM (SELECT 'reference' AS kind, range AS k, 0 AS run FROM range({FLAG_KMIN}, {FLAG_KMAX} + 1)
      UNION ALL
      SELECT 'run', a.range, b.range FROM range({FLAG_KMIN}, {FLAG_KMAX} + 1) a, range(1, {FLAG_RUNS} + 1) b) g, n""")
def q_model_grid(spark, sf_dir):
    """The sweep grid with the number of documents of each model."""
    from ..operators import vectorize as vz
    docs = vz.prepare_documents(table(spark, sf_dir, "documents"))
    n = docs.agg(F.count(F.lit(1))).scalar()
    g = sm.model_grid(spark, "nmf", FLAG_KMIN, FLAG_KMAX, FLAG_RUNS, O.SEED)
    n_docs = F.when(F.col("run") == 0, n).otherwise(F.floor(F.lit(O.RATIO) * n))
    return g.select("algo", "kind", i64("k").alias("k"), i64("run").alias("run"), i64("seed").alias("seed"),
                    i64(n_docs).alias("n_docs"))


@query("prototype_sample", sql=f"""
WITH {O.docs_cte()}, {O.members_cte(FLAG_RUNS)},
mm AS (SELECT 'skm' AS algo, CASE WHEN run = 0 THEN 'reference' ELSE 'run' END AS kind, k.range AS k, run, doc_id
       FROM members, range({FLAG_KMIN}, {FLAG_KMAX} + 1) k),
p AS (SELECT *, row_number() OVER (PARTITION BY algo, kind, k, run
              ORDER BY md5(concat_ws(':', '{O.SEED}', 'proto', algo, kind, k, run, doc_id))) AS rn FROM mm)
SELECT CAST(k AS BIGINT) AS k, CAST(run AS BIGINT) AS run, CAST(doc_id AS BIGINT) AS doc_id,
       CAST(rn - 1 AS BIGINT) AS topic FROM p WHERE rn <= k""")
def q_prototype_sample(spark, sf_dir):
    """K distinct prototype documents per model."""
    from ..operators import vectorize as vz
    docs = vz.prepare_documents(table(spark, sf_dir, "documents"))
    mm = sm.model_members(docs.select("doc_id"), "skm", FLAG_KMIN, FLAG_KMAX, FLAG_RUNS, O.RATIO, O.SEED)
    p = sm.prototype_sample(mm, KEYS, FLAG_KMAX, seed=O.SEED)
    return p.select(i64("k").alias("k"), i64("run").alias("run"), i64("doc_id").alias("doc_id"),
                    i64("topic").alias("topic"))


@query("class_partition", sql=f"""
WITH {O.docs_cte()},
l AS (SELECT d.doc_id, CAST(b.quality AS VARCHAR) AS label FROM docs d LEFT JOIN labels b USING (doc_id)),
idx AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS class_idx
        FROM (SELECT DISTINCT label FROM l WHERE label IS NOT NULL))
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(coalesce(class_idx, -1) AS BIGINT) AS class_idx
FROM l LEFT JOIN idx USING (label)""")
def q_class_partition(spark, sf_dir):
    """Class index of every kept document (labels.quality), -1 without."""
    from ..operators import vectorize as vz
    docs = vz.prepare_documents(table(spark, sf_dir, "documents"))
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    d = docs.select("doc_id").join(lab, "doc_id", "left")
    return ce.class_partition(d).select(i64("doc_id").alias("doc_id"), i64("class_idx").alias("class_idx"))


@query("missing_class_docs", sql=f"""
WITH {O.docs_cte()}, {O.members_cte(FLAG_RUNS)}
SELECT DISTINCT CAST(doc_id AS BIGINT) AS doc_id FROM members
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_missing_class_docs(spark, sf_dir):
    """Clustered (sampled) documents with no ground-truth class."""
    from ..operators import vectorize as vz
    docs = vz.prepare_documents(table(spark, sf_dir, "documents"))
    mem = sm.run_members(docs.select("doc_id"), FLAG_RUNS, O.RATIO, O.SEED)
    miss = ce.missing_class_docs(mem, table(spark, sf_dir, "labels"))
    return miss.select(i64("doc_id").alias("doc_id"))


@query("centroids", sql=f"""
WITH {O.matrix_ctes(label_col='source')}, {lang_rank_sql()}
SELECT CAST(topic AS BIGINT) AS topic, CAST(term_idx AS BIGINT) AS term_idx, round(w, 6) AS weight FROM ccent""")
def q_centroids(spark, sf_dir):
    """Mean TF-IDF vector of every language class."""
    c = corpus(spark, sf_dir, label_col="source", cfg=MATRIX_CFG)
    part = lang_classes(spark, sf_dir, c).select("doc_id", F.col("class_idx").alias("topic"))
    cent = ce.build_centroids(c.rows, part, [])
    return cent.select(i64("topic").alias("topic"), i64("term_idx").alias("term_idx"), r6("weight").alias("weight"))


@query("topic_rankings", sql=f"""
WITH {O.matrix_ctes(label_col='source')}, {lang_rank_sql(FLAG_TOP)}
SELECT CAST(topic AS BIGINT) AS topic, printf('C%02d', topic + 1) AS label, CAST(rank AS BIGINT) AS rank, term,
       round(w, 6) AS weight FROM crk""")
def q_topic_rankings(spark, sf_dir):
    """Top terms of each class centroid (dense order: weight, term)."""
    c = corpus(spark, sf_dir, label_col="source", cfg=MATRIX_CFG)
    r = va.class_rankings(c.rows, lang_classes(spark, sf_dir, c), c.vocab, top=FLAG_TOP)
    return r.select(i64("topic").alias("topic"), "label", i64("rank").alias("rank"), "term", r6("weight").alias("weight"))


@query("rankings_size", sql=f"""
WITH {O.matrix_ctes(label_col='source')}, {lang_rank_sql()}
SELECT CAST(min(n) AS BIGINT) AS size FROM (SELECT topic, count(*) AS n FROM ccent GROUP BY topic)""")
def q_rankings_size(spark, sf_dir):
    """Shortest ranking of the sparse class rankings (non-zero terms only)."""
    c = corpus(spark, sf_dir, label_col="source", cfg=MATRIX_CFG)
    part = lang_classes(spark, sf_dir, c).select("doc_id", F.col("class_idx").alias("topic")).withColumn("s", F.lit(1))
    cent = ce.build_centroids(c.rows, part, ["s"])
    r = rk.rank_terms(cent, c.vocab, ["s"], top=-1, densify=False)
    return rk.rankings_size(r, ["s"]).select(i64("size").alias("size"))


@query("truncate_rankings", sql=f"""
WITH {class_fold_sql()}
SELECT CAST(k AS BIGINT) AS k, CAST(run AS BIGINT) AS run, CAST(topic AS BIGINT) AS topic, CAST(rank AS BIGINT) AS rank,
       term FROM top_r WHERE rank <= 5""")
def q_truncate_rankings(spark, sf_dir):
    """First 5 terms of every ranking of the sweep."""
    _, r = fold_rankings(spark, sf_dir)
    t = rk.truncate_rankings(r, 5)
    return t.select(i64("k").alias("k"), i64("run").alias("run"), i64("topic").alias("topic"),
                    i64("rank").alias("rank"), "term")


def _ref_vs_lang_sql(metric: str) -> str:
    """Class rankings (lang) against the reference models' rankings, top 20."""
    if metric == "jaccard":
        body = """SELECT x.k, x.row, x.col,
       CASE WHEN inter = 0 THEN 0.0 ELSE inter / (la + lb - inter) END AS score
FROM (SELECT a.k, a.topic AS row, b.topic AS col, count(*)::DOUBLE AS inter
      FROM refr a JOIN crk b ON a.term = b.term GROUP BY ALL) x
RIGHT JOIN (SELECT a.k, a.topic AS row, b.topic AS col, a.n AS la, b.n AS lb
            FROM (SELECT k, topic, count(*) AS n FROM refr GROUP BY ALL) a,
                 (SELECT topic, count(*) AS n FROM crk GROUP BY ALL) b) y
  ON x.k = y.k AND x.row = y.row AND x.col = y.col"""
        # inter null -> 0
        body = body.replace("CASE WHEN inter = 0", "CASE WHEN coalesce(inter, 0) = 0").replace(
            "SELECT x.k, x.row, x.col", "SELECT y.k, y.row, y.col")
        return f"""
WITH {class_fold_sql()}, {lang_rank_sql(FLAG_TOP)},
refr AS (SELECT k, topic, rank, term FROM top_r WHERE run = 0)
SELECT CAST(k AS BIGINT) AS k, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(score, 6) AS score
FROM ({body}) s"""
    return f"""
WITH {class_fold_sql()}, {lang_rank_sql(FLAG_TOP)},
refr AS (SELECT k, topic, rank, term FROM top_r WHERE run = 0),
crk2 AS (SELECT r.k, c.topic, c.rank, c.term FROM crk c, (SELECT DISTINCT k FROM refr) r),
{O.aj_ctes('refr', 'crk2', ['k'])}
SELECT CAST(k AS BIGINT) AS k, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(score, 6) AS score FROM aj"""


def _ref_vs_lang(spark, sf_dir, metric):
    c, r = fold_rankings(spark, sf_dir)
    ref = r.where(F.col("kind") == "reference").select("k", "topic", "rank", "term")
    cls = va.class_rankings(c.rows, lang_classes(spark, sf_dir, c), c.vocab, top=FLAG_TOP)
    one = F.lit("classes").alias("set")  # both sides carry it: the class rankings meet every model's
    sims = va.class_similarity(cls.select(one, "topic", "rank", "term"), ref.select(one, "*"), ["set"], ["set", "k"],
                               metric, classes_first=False)
    return sims.select(i64("k").alias("k"), i64("row").alias("row"), i64("col").alias("col"), r6("score").alias("score"))


@query("jaccard", sql=_ref_vs_lang_sql("jaccard"))
def q_jaccard(spark, sf_dir):
    """G1: binary Jaccard between reference-model and class rankings."""
    return _ref_vs_lang(spark, sf_dir, "jaccard")


@query("average_jaccard", sql=_ref_vs_lang_sql("average_jaccard"))
def q_average_jaccard(spark, sf_dir):
    """Average Jaccard between reference-model and class rankings."""
    return _ref_vs_lang(spark, sf_dir, "average_jaccard")


REF_TST = """ref AS (SELECT r.run, t.k, t.topic, t.rank, t.term
        FROM top_r t JOIN (SELECT DISTINCT run, k FROM top_r WHERE run > 0) r ON r.k = t.k WHERE t.run = 0),
tst AS (SELECT run, k, topic, rank, term FROM top_r WHERE run > 0)"""


@query("similarity_matrix", sql=f"""
WITH {class_fold_sql()}, {REF_TST}, {O.aj_ctes('ref', 'tst', ['run', 'k'])}
SELECT CAST(k AS BIGINT) AS k, CAST(run AS BIGINT) AS run, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col,
       round(score, 6) AS score FROM aj""")
def q_similarity_matrix(spark, sf_dir):
    """Reference topics x run topics, Average Jaccard at depth 20."""
    _, r = fold_rankings(spark, sf_dir)
    s = st.reference_pair_scores(r, FLAG_TOP)
    return s.select(i64("k").alias("k"), i64("run").alias("run"), i64("row").alias("row"), i64("col").alias("col"),
                    r6("score").alias("score"))


@query("optimal_assignment", sql=f"""
WITH {class_fold_sql()}, {REF_TST}, {O.aj_ctes('ref', 'tst', ['run', 'k'])}, {O.assignment_ctes('aj', ['run', 'k'])}
SELECT CAST(k AS BIGINT) AS k, CAST(run AS BIGINT) AS run, round(total, 6) AS total, CAST(pairs AS BIGINT) AS pairs
FROM asg""")
def q_optimal_assignment(spark, sf_dir):
    """Total similarity of the best one-to-one topic matching per run."""
    _, r = fold_rankings(spark, sf_dir)
    m = mt.optimal_assignment(st.reference_pair_scores(r, FLAG_TOP), ["algo", "k", "run"])
    t = m.groupBy("k", "run").agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("pairs"))
    return t.select(i64("k").alias("k"), i64("run").alias("run"), r6("total").alias("total"), i64("pairs").alias("pairs"))


@query("ranking_set_agreement", sql=f"""
WITH {class_fold_sql()}, {REF_TST}, {O.aj_ctes('ref', 'tst', ['run', 'k'])}, {O.assignment_ctes('aj', ['run', 'k'])}
SELECT CAST(k AS BIGINT) AS k, CAST(run AS BIGINT) AS run, round(total / pairs, 6) AS agreement FROM asg""")
def q_ranking_set_agreement(spark, sf_dir):
    """Mean matched similarity of each run with the reference."""
    _, r = fold_rankings(spark, sf_dir)
    a = st.run_agreement(r, FLAG_TOP)
    return a.select(i64("k").alias("k"), i64("run").alias("run"), r6("agreement").alias("agreement"))


@query("best_k", sql=f"""
WITH s AS ({stability_sql()})
SELECT algo, k, stability, CAST(row_number() OVER (PARTITION BY algo ORDER BY stability DESC, k) AS BIGINT) AS position
FROM s""")
def q_best_k(spark, sf_dir):
    """K ordered by stability."""
    s = flagship(spark, sf_dir)
    b = st.best_k(s)
    return b.select("algo", i64("k").alias("k"), r6("stability").alias("stability"), i64("position").alias("position"))


@query("rankings_wide", sql=f"""
WITH {class_fold_sql(top=10)},
w AS (SELECT k, rank, {", ".join(f"coalesce(max(CASE WHEN topic = {t} THEN term END), '') AS C{t + 1:02d}" for t in range(FLAG_KMAX))}
      FROM top_r WHERE run = 0 GROUP BY k, rank)
SELECT CAST(k AS BIGINT) AS k, CAST(rank AS BIGINT) AS rank, {", ".join(f"C{t + 1:02d}" for t in range(FLAG_KMAX))} FROM w""")
def q_rankings_wide(spark, sf_dir):
    """Reference rankings as a table, one column per topic label."""
    _, r = fold_rankings(spark, sf_dir, top=10)
    ref = r.where(F.col("kind") == "reference")
    w = rk.rankings_wide(ref, ["k"], top=10)
    labels = [f"C{t + 1:02d}" for t in range(FLAG_KMAX)]
    for lab in labels:
        if lab not in w.columns:
            w = w.withColumn(lab, F.lit(""))
    return w.select(i64("k").alias("k"), i64("rank").alias("rank"), *labels)


@query("rankings_long", sql=f"""
WITH {class_fold_sql(top=10)},
r AS (SELECT k, topic, printf('C%02d', topic + 1) AS label, string_agg(term, ', ' ORDER BY rank) AS terms
      FROM top_r WHERE run = 0 GROUP BY k, topic)
SELECT CAST(k AS BIGINT) AS k, CAST(topic AS BIGINT) AS topic,
       rpad(label, CAST(max(length(label)) OVER (PARTITION BY k) + 1 AS INTEGER), ' ') || ': ' || terms AS line FROM r""")
def q_rankings_long(spark, sf_dir):
    """One display line per reference topic."""
    _, r = fold_rankings(spark, sf_dir, top=10)
    ref = r.where(F.col("kind") == "reference")
    lines = rk.rankings_long(ref, ["k"], top=10)
    return lines.select(i64("k").alias("k"), i64("topic").alias("topic"), "line")
