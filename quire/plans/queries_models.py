"""Queries for the topic models: distances, k-means, NMF, LDA (D)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import kmeans as km
from ..operators import nmf as nm
from ..operators import rankings as rk
from ..operators import sampling as sm
from ..operators import stability as st
from ..session import cut_lineage, scratch_path
from ..sources import store
from . import oracle_sql as O
from .catalog import MATRIX_CFG, corpus, i64, query, r6, table

N_PROTO = 10
METRICS = ("cosine", "euclidean", "cityblock", "chebyshev")


def _prototypes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    key = F.md5(F.concat_ws(":", F.lit(str(O.SEED)), F.lit("proto"), F.col("vec_id").cast("string")))
    return e.orderBy(key).limit(N_PROTO).select(
        F.row_number().over(Window.orderBy(key)).alias("_r"),  # N_PROTO rows
        "embedding").select((F.col("_r") - 1).cast("int").alias("topic"), "embedding")


PROTO_SQL = f"""proto AS (SELECT CAST(row_number() OVER (ORDER BY md5(concat_ws(':', '{O.SEED}', 'proto', vec_id))) - 1 AS INTEGER) AS topic,
                     CAST(embedding AS DOUBLE[]) AS c
              FROM embeddings ORDER BY md5(concat_ws(':', '{O.SEED}', 'proto', vec_id)) LIMIT {N_PROTO}),
pts AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
dist AS (SELECT vec_id, topic,
  CASE WHEN sqrt(list_sum(list_transform(x, lambda v: v * v))) = 0 OR sqrt(list_sum(list_transform(c, lambda v: v * v))) = 0
       THEN 1.0 ELSE 1 - list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * c[i]))
            / (sqrt(list_sum(list_transform(x, lambda v: v * v))) * sqrt(list_sum(list_transform(c, lambda v: v * v)))) END AS cosine,
  sqrt(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))) AS euclidean,
  list_sum(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - c[i]))) AS cityblock,
  list_max(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - c[i]))) AS chebyshev
  FROM pts, proto)"""


@query("pairwise_distance", sql=f"""
WITH {PROTO_SQL}
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(topic AS BIGINT) AS topic, round(cosine, 6) + 0.0 AS cosine,
       round(euclidean, 6) + 0.0 AS euclidean, round(cityblock, 6) + 0.0 AS cityblock, round(chebyshev, 6) + 0.0 AS chebyshev
FROM dist""")
def q_pairwise_distance(spark, sf_dir):
    """Distance of every embedding to 10 md5-chosen prototypes, 4 metrics."""
    pts = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    d = km.distances_to_centres(pts, _prototypes(spark, sf_dir), "embedding", METRICS)
    return d.select(i64("vec_id").alias("vec_id"), i64("topic").alias("topic"), *[r6(m).alias(m) for m in METRICS])


@query("kmeans_step", sql=f"""
WITH {PROTO_SQL},
b AS (SELECT vec_id, arg_min(topic, (round(cosine, 12), topic)) AS topic, min(cosine) AS distance FROM dist GROUP BY vec_id)
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(topic AS BIGINT) AS topic, round(distance, 6) + 0.0 AS distance FROM b""")
def q_kmeans_step(spark, sf_dir):
    """D11 (one assignment step, cosine) on the embeddings from 10 prototypes."""
    pts = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    d = km.distances_to_centres(pts, _prototypes(spark, sf_dir), "embedding", ("cosine",))
    n = km.nearest(d, ["vec_id"], "cosine")
    return n.select(i64("vec_id").alias("vec_id"), i64("topic").alias("topic"), r6("distance").alias("distance"))


@query("kmeans_centres", sql=f"""
WITH {PROTO_SQL},
b AS (SELECT vec_id, arg_min(topic, (round(cosine, 12), topic)) AS topic FROM dist GROUP BY vec_id),
e AS (SELECT b.topic, unnest(range(0, len(x))) AS dim, unnest(x) AS v FROM pts JOIN b USING (vec_id))
SELECT CAST(topic AS BIGINT) AS topic, CAST(dim AS BIGINT) AS dim, round(avg(v), 6) + 0.0 AS value FROM e GROUP BY ALL""")
def q_kmeans_centres(spark, sf_dir):
    """D11 (one centre update): means of the embeddings assigned to each of 10 prototypes."""
    pts = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    d = km.distances_to_centres(pts, _prototypes(spark, sf_dir), "embedding", ("cosine",))
    c = km.dense_centres(pts, km.nearest(d, ["vec_id"], "cosine"), "vec_id")
    return c.select(i64("topic").alias("topic"), i64("dim").alias("dim"), r6("value").alias("value"))


SWEEP_KMIN, SWEEP_KMAX, SWEEP_RUNS = 2, 3, 2
SKM_ITERATIONS, SKM_DELTA = 10, 0.001
KEYS = ["algo", "kind", "k", "run"]


def _skm(spark, sf_dir, max_iter=SKM_ITERATIONS):
    c = corpus(spark, sf_dir, label_col="lang", cfg=MATRIX_CFG)
    rows = c.sampled(SWEEP_RUNS, O.RATIO, O.SEED)
    mem = sm.run_row_members(rows, "skm", SWEEP_KMIN, SWEEP_KMAX)
    protos = cut_lineage(sm.prototype_sample(mem, KEYS, SWEEP_KMAX, seed=O.SEED))  # models x topics rows, read several times
    init = km.prototype_centres(rows, protos, KEYS)
    cent, assign, iters = km.kmeans(rows, mem, init, KEYS, max_iter=max_iter, topics=protos, terms=c.vocab.count())
    return c, cent, assign, iters


def _skm_sql() -> str:
    """Spherical k-means of the sweep, its iterations written out: ``fin`` has the assignment of the last iteration of each
    model, ``ends`` its number and mean distance."""
    out = f"""WITH {O.matrix_ctes()}, {O.members_cte(SWEEP_RUNS)},
mem AS MATERIALIZED (SELECT CASE WHEN m.run = 0 THEN 'reference' ELSE 'run' END AS kind, k.range::INTEGER AS k, m.run, m.doc_id
        FROM members m, range({SWEEP_KMIN}, {SWEEP_KMAX} + 1) k),
protos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, run ORDER BY
             md5(concat_ws(':', '{O.SEED}', 'proto', 'skm', kind, k, run, doc_id))) - 1 AS topic FROM mem) WHERE topic < k),
size AS (SELECT doc_id, sqrt(sum(weight * weight)) AS n FROM dt GROUP BY doc_id),
c1 AS MATERIALIZED (SELECT k, run, topic, term_idx, weight AS w FROM protos JOIN dt USING (doc_id)),
a0 AS (SELECT DISTINCT k, run, 0.0::DOUBLE AS av, false AS over FROM mem)"""
    for i in range(1, SKM_ITERATIONS + 1):
        out += f""",
n{i} AS (SELECT k, run, topic, sqrt(sum(w * w)) AS n FROM c{i} GROUP BY ALL),
o{i} AS (SELECT mem.k, mem.run, mem.doc_id, c.topic, sum(dt.weight * c.w) AS dot
         FROM mem JOIN dt USING (doc_id) JOIN c{i} c ON c.k = mem.k AND c.run = mem.run AND c.term_idx = dt.term_idx GROUP BY ALL),
e{i} AS (SELECT mem.k, mem.run, mem.doc_id, p.topic,
                CASE WHEN coalesce(size.n, 0) = 0 OR coalesce(n.n, 0) = 0 THEN 1.0 ELSE 1 - coalesce(o.dot, 0) / (size.n * n.n) END AS d
         FROM mem JOIN (SELECT k, run, topic FROM protos) p USING (k, run) LEFT JOIN size USING (doc_id)
         LEFT JOIN n{i} n ON n.k = mem.k AND n.run = mem.run AND n.topic = p.topic
         LEFT JOIN o{i} o ON o.k = mem.k AND o.run = mem.run AND o.doc_id = mem.doc_id AND o.topic = p.topic),
b{i} AS MATERIALIZED (SELECT k, run, doc_id, arg_min(topic, (round(d, 12), topic)) AS topic, arg_min(d, (round(d, 12), topic)) AS d FROM e{i} GROUP BY ALL),
a{i} AS MATERIALIZED (SELECT k, run, avg(d) AS av, {1 - SKM_DELTA} * any_value(a.av) <= avg(d) AND avg(d) <= any_value(a.av) OR {i} = {SKM_ITERATIONS} AS over
         FROM b{i} JOIN a{i - 1} a USING (k, run) GROUP BY k, run)"""
        if i < SKM_ITERATIONS:
            out += f""",
c{i + 1} AS MATERIALIZED (SELECT b.k, b.run, b.topic, dt.term_idx, sum(dt.weight) / any_value(s.n) AS w
         FROM b{i} b JOIN (SELECT k, run, topic, count(*) AS n FROM b{i} GROUP BY ALL) s USING (k, run, topic) JOIN dt USING (doc_id)
         GROUP BY ALL UNION ALL SELECT c.* FROM c{i} c ANTI JOIN b{i} USING (k, run, topic))"""
    ends = " UNION ALL ".join(f"SELECT k, run, av, over, {i} AS it FROM a{i}" for i in range(1, SKM_ITERATIONS + 1))
    fin = " UNION ALL ".join(f"SELECT b.*, {i} AS it FROM b{i} b" for i in range(1, SKM_ITERATIONS + 1))
    return out + f""",
ends AS (SELECT k, run, min(it) AS it, arg_min(av, it) AS av FROM ({ends}) x WHERE over GROUP BY ALL),
fin AS (SELECT f.* FROM ({fin}) f JOIN ends USING (k, run, it))"""


@query("kmeans_fit", sql=_skm_sql() + """
SELECT 'skm' AS algo, CASE WHEN run = 0 THEN 'reference' ELSE 'run' END AS kind, k::BIGINT AS k, run::BIGINT AS run,
       it::BIGINT AS iterations, round(av, 6) AS avg_distance FROM ends""")
def q_kmeans_fit(spark, sf_dir):
    """Spherical k-means sweep (k=2..3, reference + 2 runs): iterations
    used and final mean cosine distance per model."""
    _, _, _, iters = _skm(spark, sf_dir)
    return iters.select("algo", "kind", i64("k").alias("k"), i64("run").alias("run"),
                        i64("iterations").alias("iterations"), r6("avg_distance").alias("avg_distance"))


@query("skm_partition", sql=_skm_sql() + """
SELECT 'skm' AS algo, CASE WHEN run = 0 THEN 'reference' ELSE 'run' END AS kind, k::BIGINT AS k, run::BIGINT AS run,
       doc_id::BIGINT AS doc_id, topic::BIGINT AS topic FROM fin""")
def q_skm_partition(spark, sf_dir):
    """The document partition of every spherical k-means model."""
    _, _, assign, _ = _skm(spark, sf_dir)
    return assign.select("algo", "kind", i64("k").alias("k"), i64("run").alias("run"), i64("doc_id").alias("doc_id"),
                         i64("topic").alias("topic"))


@query("skm_stability")
def q_skm_stability(spark, sf_dir):
    """D13 + D14 + G6: term rankings of the centroids and the stability per k."""
    c, cent, _, _ = _skm(spark, sf_dir)
    r = rk.rank_terms(cent, c.vocab, KEYS, top=20)
    s = st.stability_by_k(r, 20)
    return s.select("algo", i64("k").alias("k"), r6("stability").alias("stability"), i64("n_runs").alias("n_runs"))


@query("sparse_distances", sql=f"""
WITH {O.matrix_ctes()}, {O.class_idx_cte()},
size AS (SELECT class_idx, count(*) AS n FROM cls GROUP BY class_idx),
cen AS (SELECT class_idx AS topic, term_idx, sum(weight) / any_value(size.n) AS c FROM dt JOIN cls USING (doc_id) JOIN size USING (class_idx) GROUP BY ALL),
x AS (SELECT d.doc_id, t.topic, v.term_idx, coalesce(dt.weight, 0) AS x, coalesce(cen.c, 0) AS c
      FROM docs d CROSS JOIN (SELECT DISTINCT topic FROM cen) t CROSS JOIN vocab v
      LEFT JOIN dt ON dt.doc_id = d.doc_id AND dt.term_idx = v.term_idx LEFT JOIN cen ON cen.topic = t.topic AND cen.term_idx = v.term_idx),
d AS (SELECT doc_id, topic, sum(x * c) AS dot, sum(x * x) AS xx, sum(c * c) AS cc, sqrt(sum((x - c) ** 2)) AS euclidean,
             sum(abs(x - c)) AS cityblock, max(abs(x - c)) AS chebyshev, sum(abs(x - c) ** 3) ** (1.0 / 3) AS minkowski FROM x GROUP BY ALL)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(topic AS BIGINT) AS topic,
       round(CASE WHEN xx = 0 OR cc = 0 THEN 1.0 ELSE 1 - dot / (sqrt(xx) * sqrt(cc)) END, 6) + 0.0 AS cosine, round(euclidean, 6) AS euclidean,
       round(cityblock, 6) AS cityblock, round(chebyshev, 6) AS chebyshev, round(minkowski, 6) AS minkowski FROM d""")
def q_sparse_distances(spark, sf_dir):
    """D12 + E9 (sparse rows): every document's distances to the language centroids by five metrics."""
    from ..operators.centroids import build_centroids, class_partition

    c = corpus(spark, sf_dir, label_col="lang", cfg=MATRIX_CFG).settle()
    part = class_partition(c.rows, kept=("terms", "weights")).where("class_idx >= 0").select(
        F.lit("lang").alias("model_name"), "doc_id", F.col("class_idx").alias("topic"), "terms", "weights")
    d = km.sparse_distances(c.rows, None, build_centroids(part, None, ["model_name"]), ["model_name"], terms=max(1, c.vocab.count()))
    return d.select(i64("doc_id").alias("doc_id"), i64("topic").alias("topic"), *[r6(m).alias(m) for m in km.SPARSE_METRICS])


def _nmf_start_sql(k: int) -> str:
    key = "'nmf', 'reference', " + str(k) + ", 0"
    return f"""W0 AS (SELECT d.doc_id, CAST(t.range AS INTEGER) AS topic,
              (('0x' || substr(md5(concat_ws(':', '{O.SEED}', 'w', {key}, d.doc_id, t.range)), 1, 8))::BIGINT + 1) / 4294967296.0 AS w
       FROM docs d, range(0, {k}) t),
H0 AS (SELECT CAST(t.range AS INTEGER) AS topic, v.term_idx,
              (('0x' || substr(md5(concat_ws(':', '{O.SEED}', 'h', {key}, t.range, v.term_idx)), 1, 8))::BIGINT + 1) / 4294967296.0 AS h
       FROM vocab v, range(0, {k}) t),
wtx AS (SELECT W0.topic, dt.term_idx, sum(dt.weight * W0.w) AS n FROM dt JOIN W0 USING (doc_id) GROUP BY ALL),
wtw AS (SELECT a.topic AS t1, b.topic AS t2, sum(a.w * b.w) AS g FROM W0 a JOIN W0 b USING (doc_id) GROUP BY ALL),
wtwh AS (SELECT g.t1 AS topic, H0.term_idx, sum(g.g * H0.h) AS d FROM H0 JOIN wtw g ON g.t2 = H0.topic GROUP BY ALL),
H1 AS (SELECT H0.topic, H0.term_idx, H0.h * coalesce(wtx.n, 0) / (coalesce(wtwh.d, 0) + 1e-9) AS h
       FROM H0 LEFT JOIN wtx USING (topic, term_idx) LEFT JOIN wtwh USING (topic, term_idx)),
xht AS (SELECT dt.doc_id, H1.topic, sum(dt.weight * H1.h) AS n FROM dt JOIN H1 USING (term_idx) GROUP BY ALL),
hht AS (SELECT a.topic AS t1, b.topic AS t2, sum(a.h * b.h) AS g FROM H1 a JOIN H1 b USING (term_idx) GROUP BY ALL),
whht AS (SELECT g.t1 AS topic, W0.doc_id, sum(g.g * W0.w) AS d FROM W0 JOIN hht g ON g.t2 = W0.topic GROUP BY ALL),
W1 AS (SELECT W0.doc_id, W0.topic, W0.w * coalesce(xht.n, 0) / (coalesce(whht.d, 0) + 1e-9) AS w
       FROM W0 LEFT JOIN xht USING (doc_id, topic) LEFT JOIN whht USING (doc_id, topic))"""


STEP_K = 3


def _nmf_one_step(spark, sf_dir):
    c = corpus(spark, sf_dir, label_col="lang", cfg=MATRIX_CFG)
    mem = sm.model_members(c.docs.select("doc_id"), "nmf", STEP_K, STEP_K, 0, O.RATIO, O.SEED)
    X = nm.model_rows(c.rows, mem, KEYS)
    W0, H0 = nm.random_start(mem, c.vocab, KEYS, O.SEED)
    H1 = nm.update_h(X, W0, H0, KEYS)
    W1 = nm.update_w(X, W0, H1, KEYS)
    return c, H1, W1


@query("nmf_step", sql=f"""
WITH {O.matrix_ctes()}, {_nmf_start_sql(STEP_K)}
SELECT CAST(topic AS BIGINT) AS topic, CAST(term_idx AS BIGINT) AS term_idx, round(h, 6) AS h FROM H1""")
def q_nmf_step(spark, sf_dir):
    """D1 (one multiplicative H update, Frobenius) from the md5 start, k=3."""
    _, H1, _ = _nmf_one_step(spark, sf_dir)
    return H1.select(i64("topic").alias("topic"), i64("term_idx").alias("term_idx"), r6("h").alias("h"))


@query("argmax_partition", sql=f"""
WITH {O.matrix_ctes()}, {_nmf_start_sql(STEP_K)}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(arg_max(topic, (round(w, 12), -topic)) AS BIGINT) AS topic
FROM W1 GROUP BY doc_id""")
def q_argmax_partition(spark, sf_dir):
    """Argmax of W after one full NMF step (H then W)."""
    _, _, W1 = _nmf_one_step(spark, sf_dir)
    p = nm.argmax_partition(W1, KEYS)
    return p.select(i64("doc_id").alias("doc_id"), i64("topic").alias("topic"))


@query("nmf_kl_step", sql=f"""
WITH {O.matrix_ctes()}, {_nmf_start_sql(STEP_K).split(',' + chr(10) + 'wtx AS')[0]},
wh AS (SELECT dt.doc_id, dt.term_idx, any_value(dt.weight) AS x, sum(W0.w * H0.h) AS wh
       FROM dt JOIN W0 USING (doc_id) JOIN H0 ON H0.topic = W0.topic AND H0.term_idx = dt.term_idx GROUP BY ALL),
r AS (SELECT doc_id, term_idx, x / (wh + 1e-9) AS r FROM wh),
num AS (SELECT W0.topic, r.term_idx, sum(r.r * W0.w) AS n FROM r JOIN W0 USING (doc_id) GROUP BY ALL),
den AS (SELECT topic, sum(w) AS d FROM W0 GROUP BY topic)
SELECT CAST(H0.topic AS BIGINT) AS topic, CAST(H0.term_idx AS BIGINT) AS term_idx,
       round(H0.h * coalesce(num.n, 0) / (den.d + 1e-9), 6) AS h
FROM H0 LEFT JOIN num USING (topic, term_idx) JOIN den USING (topic)""")
def q_nmf_kl_step(spark, sf_dir):
    """D3: one divergence (KL) multiplicative H update from the md5 start."""
    c = corpus(spark, sf_dir, label_col="lang", cfg=MATRIX_CFG)
    mem = sm.model_members(c.docs.select("doc_id"), "nmf", STEP_K, STEP_K, 0, O.RATIO, O.SEED)
    X = nm.model_rows(c.rows, mem, KEYS)
    W0, H0 = nm.random_start(mem, c.vocab, KEYS, O.SEED)
    H1 = nm.update_h_kl(X, W0, H0, KEYS)
    return H1.select(i64("topic").alias("topic"), i64("term_idx").alias("term_idx"), r6("h").alias("h"))


def _nmf_sweep(spark, sf_dir, iters=10):
    c = corpus(spark, sf_dir, label_col="lang", cfg=MATRIX_CFG)
    mem = sm.model_members(c.docs.select("doc_id"), "nmf", SWEEP_KMIN, SWEEP_KMAX, SWEEP_RUNS, O.RATIO, O.SEED)
    W, H, errors = nm.fit(c.rows, mem, c.vocab, KEYS, max_iter=iters, seed=O.SEED)
    return c, mem, W, H, errors


@query("nmf_fit")
def q_nmf_fit(spark, sf_dir):
    """D1 + D4 + D20: NMF sweep (k=2..3, reference + 2 runs, 10 iterations):
    top-10 term rankings of every model."""
    c, _, _, H, _ = _nmf_sweep(spark, sf_dir)
    r = rk.rank_terms(nm.factor_weights(H, KEYS), c.vocab, KEYS, top=10)
    return r.select("algo", "kind", i64("k").alias("k"), i64("run").alias("run"), i64("topic").alias("topic"),
                    i64("rank").alias("rank"), "term", r6("weight").alias("weight"))


@query("nmf_error")
def q_nmf_error(spark, sf_dir):
    """D1 objective after the sweep: ||X - WH||^2 per model (no dense product)."""
    _, _, _, _, errors = _nmf_sweep(spark, sf_dir)
    return errors.select("algo", "kind", i64("k").alias("k"), i64("run").alias("run"), i64("n_iter").alias("n_iter"),
                         r6("error").alias("error"))


@query("factors_roundtrip", sql=f"""
WITH {O.matrix_ctes()}, {_nmf_start_sql(STEP_K)}
SELECT 'W' AS factor, CAST(topic AS BIGINT) AS topic, CAST(doc_id AS BIGINT) AS id, round(w, 6) AS value FROM W1
UNION ALL SELECT 'H', CAST(topic AS BIGINT), CAST(term_idx AS BIGINT), round(h, 6) FROM H1""")
def q_factors_roundtrip(spark, sf_dir):
    """Both factors after one NMF step written by (algo, k) and read back."""
    _, H1, W1 = _nmf_one_step(spark, sf_dir)
    paths = {}
    for name, factor in (("W", W1.withColumnsRenamed({"doc_id": "id", "w": "value"})),
                         ("H", H1.withColumnsRenamed({"term_idx": "id", "h": "value"}))):
        paths[name] = scratch_path(spark, f"factor-{name}")
        store.save_partitions(factor.select(*KEYS, "topic", i64("id").alias("id"), "value"), paths[name])
    back = [store.load_table(spark, p).select(F.lit(n).alias("factor"), i64("topic").alias("topic"), "id", r6("value").alias("value"))
            for n, p in paths.items()]
    return back[0].unionByName(back[1])
