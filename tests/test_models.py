"""Invariants of the iterative models on a planted corpus."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import blocks as bl
from quire.operators import kmeans as km
from quire.operators import nmf as nm
from quire.operators import sampling as sm
from quire.operators import vectorize as vz
from quire.operators.validation import partition_scores
from quire.session import cut_lineage

KEYS = ["algo", "kind", "k", "run"]


def planted(spark, blocks=3, per_block=12):
    rows = []
    for b in range(blocks):
        vocab = [f"w{b}x{i}" for i in range(6)]
        for d in range(per_block):
            words = [vocab[(d + j) % 6] for j in range(4)] * 2
            rows.append((b * 100 + d, str(b), " ".join(words) + "\n"))
    docs = spark.createDataFrame(rows, "doc_id long, label string, body string")
    return vz.build_corpus(docs, vz.CorpusConfig(min_df=1, tfidf=True, norm=True, min_doc_length=0))


@pytest.mark.parametrize("objective, start", [("fro", "random"), ("fro", "nndsvd"), ("kl", "random")])
def test_nmf_recovers_blocks(spark, objective, start):
    c = planted(spark)
    mem = sm.model_members(c.docs.select("doc_id"), "nmf", 3, 3, 1)
    W, H = nm.nmf(c.doc_terms, mem, c.vocab, KEYS, max_iter=20, objective=objective, start=start)
    assert H.where(F.col("h") < 0).count() == 0 and W.where(F.col("w") < 0).count() == 0
    part = nm.argmax_partition(W, KEYS).join(c.docs.select("doc_id", F.col("label").cast("int").alias("class_idx")),
                                             "doc_id")
    scores = partition_scores(part, KEYS).collect()
    assert len(scores) == 2 and all(abs(s["ari"] - 1.0) < 1e-9 for s in scores)


def test_nmf_error_decreases_and_matches_the_tables(spark):
    c = planted(spark)
    mem = sm.model_members(c.docs.select("doc_id"), "nmf", 2, 2, 0)
    X = nm.model_rows(c.doc_terms, mem, KEYS)
    errs = []
    for it in (1, 3):
        W, H, errors = nm.fit(c.doc_terms, mem, c.vocab, KEYS, max_iter=it)
        errs.append(nm.squared_error(X, W, H, KEYS).first()["error"])
        assert abs(errors.first()["error"] - errs[-1]) < 1e-6 and errors.first()["n_iter"] == it
    assert errs[1] <= errs[0] + 1e-9


@pytest.mark.parametrize("objective, start", [("fro", "random"), ("fro", "nndsvd"), ("kl", "random")])
def test_nmf_is_the_same_in_blocks_of_any_size(spark, monkeypatch, objective, start):
    x = _uneven()
    rows, mem = _rows(spark, x, (2, 3))
    found = []
    for group, block in ((64 << 20, 1 << 20), (1 << 10, 200)):
        monkeypatch.setattr("quire.operators.packed.GROUP_BYTES", group)
        monkeypatch.setattr("quire.operators.blocks.BLOCK_BYTES", block)
        W, H, errors = nm.fit(rows, mem, spark.range(x.shape[1]), KEYS, max_iter=3, objective=objective, start=start)
        found.append([{tuple(r)[:-1]: r[-1] for r in t.collect()} for t in (W, H, errors)])
    assert len(found[0][0]) == 5 * len(x) and len(found[0][1]) == 5 * x.shape[1]
    for a, b in zip(*found):
        assert a.keys() == b.keys() and all(abs(a[x] - b[x]) < 1e-9 for x in a)


def _uneven():
    rng = np.random.default_rng(0)
    noise = np.where(rng.random((60, 40)) < 0.3, rng.random((60, 40)), 0)
    return noise + 3 * np.outer(rng.random(60), rng.random(40) < 0.5) + 2 * np.outer(rng.random(60) < 0.4, rng.random(40))


def _rows(spark, x, ks):
    rows = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(x) if v], "doc_id long, term_idx int, weight double")
    mem = spark.createDataFrame([("a", "b", k, 0, i) for k in ks for i in range(len(x))], "algo string, kind string, k int, run int, doc_id long")
    return rows, mem


def _matrix(c):
    x = np.zeros((c.docs.count(), c.vocab.count()))
    at = {r["doc_id"]: i for i, r in enumerate(c.docs.collect())}
    for r in c.doc_terms.collect():
        x[at[r["doc_id"]], r["term_idx"]] = r["weight"]
    return x


def _side(spark, side, m=0):
    rows = bl.table(spark, side).where(F.col("_nth") == m).collect()
    out = np.zeros((side.widths[m], side.terms))
    for r in rows:
        out[r["topic"], r["term_idx"]] = r["value"]
    return out


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_singular_vectors_are_those_of_numpy(spark, monkeypatch, block):
    monkeypatch.setattr("quire.operators.blocks.BLOCK_BYTES", block)
    x = _uneven()
    rows, mem = _rows(spark, x, (3,))
    packed, _ = nm.pack(rows, mem, KEYS)
    side, sigma = nm.singular_vectors(packed, {0: 3}, 40, passes=15)
    u, s, v = np.linalg.svd(x)
    assert np.allclose(sigma[0], s[:3], rtol=1e-8)
    got = _side(spark, side)
    assert np.allclose(np.abs(got @ v[:3].T), np.eye(3), atol=1e-5)
    h = _side(spark, nm.nndsvd_terms(packed, {0: 3}, 40, passes=15))
    for j in range(3):
        a, b = (np.linalg.norm(np.maximum(t * u[:, j], 0)) * np.linalg.norm(np.maximum(t * v[j], 0)) for t in (1, -1))
        t = 1 if a >= b else -1
        part = np.maximum(t * v[j], 0)
        want = np.sqrt(s[0]) * np.abs(v[0]) if j == 0 else np.sqrt(s[j] * max(a, b)) * part / np.linalg.norm(part)
        assert np.allclose(h[j], want, atol=1e-5)


def test_singular_vectors_of_a_matrix_of_low_rank(spark):
    c = planted(spark, blocks=2, per_block=6)
    mem = sm.model_members(c.docs.select("doc_id"), "nmf", 3, 3, 0)
    packed, _ = nm.pack(c.doc_terms, mem, KEYS)
    _, sigma = nm.singular_vectors(packed, {0: 3}, c.vocab.count(), passes=10)
    assert np.allclose(sigma[0], np.linalg.svd(_matrix(c))[1][:3], rtol=1e-6)


def test_spherical_kmeans_recovers_blocks(spark):
    c = planted(spark)
    mem = sm.model_members(c.docs.select("doc_id"), "skm", 3, 3, 0)
    init = c.doc_terms.where(F.col("doc_id").isin([0, 100, 200])).select(
        F.lit("skm").alias("algo"), F.lit("reference").alias("kind"), F.lit(3).alias("k"), F.lit(0).alias("run"),
        (F.col("doc_id") / 100).cast("int").alias("topic"), "term_idx", "weight")
    cent, assign, iters = km.kmeans(c.doc_terms, mem, init, KEYS, max_iter=10)
    assert assign.count() == c.docs.count()
    part = assign.join(c.docs.select("doc_id", F.col("label").cast("int").alias("class_idx")), "doc_id")
    assert abs(partition_scores(part, KEYS).first()["ari"] - 1.0) < 1e-9
    assert iters.first()["iterations"] <= 10


def test_stability_of_identical_runs_is_one(spark):
    from quire.operators.stability import stability_by_k

    rows = []
    for kind, run in (("reference", 0), ("run", 1), ("run", 2)):
        for topic in range(3):
            terms = [f"t{topic}_{i}" for i in range(5)]
            # runs list the topics in another order: agreement must not care
            t = topic if kind == "reference" else (topic + run) % 3
            rows += [("x", kind, 3, run, t, r + 1, term) for r, term in enumerate(terms)]
    df = spark.createDataFrame(rows, "algo string, kind string, k int, run int, topic int, rank int, term string")
    s = stability_by_k(df, 5).first()
    assert abs(s["stability"] - 1.0) < 1e-12 and s["n_runs"] == 2


def tied(spark, c):
    """The planted rows with a weak tie from each block to the next, so that no two eigenvalues are equal."""
    ties = spark.createDataFrame([(0, 6, 0.2), (100, 12, 0.3), (200, 0, 0.1)], "doc_id long, term_idx int, weight double")
    return c.doc_terms.select("doc_id", F.col("term_idx").cast("int"), "weight").unionByName(ties).groupBy(
        "doc_id", "term_idx").agg(F.sum("weight").alias("weight"))


def test_spectral_embedding_is_the_same_in_blocks_of_any_size(spark, monkeypatch):
    from quire.operators import spectral as sp

    c = planted(spark, blocks=3, per_block=8)
    rows = cut_lineage(tied(spark, c))
    found = []
    for block in (1 << 20, 300):
        monkeypatch.setattr("quire.operators.blocks.BLOCK_BYTES", block)
        monkeypatch.setattr("quire.operators.packed.GROUP_BYTES", block)
        got = sorted((r["doc_id"], *r["embedding"]) for r in sp.spectral_embedding(rows, c.docs, 18, 2, steps=2).collect())
        found.append(np.array(got)[:, 1:])
    assert np.allclose(found[0] @ found[0].T, found[1] @ found[1].T, atol=1e-8)


def test_spectral_embedding_spans_the_eigenvectors(spark):
    import numpy as np

    from quire.operators import spectral as sp

    c = planted(spark, blocks=3, per_block=8)
    rows = tied(spark, c)
    got = {r["doc_id"]: r["embedding"] for r in sp.spectral_embedding(rows, c.docs, 18, 2, steps=30).collect()}
    ids = sorted(got)
    x = np.zeros((len(ids), 18))
    for r in rows.collect():
        x[ids.index(r["doc_id"]), r["term_idx"]] = r["weight"]
    s = x @ x.T
    np.fill_diagonal(s, 0)
    root = 1 / np.sqrt(s.sum(1))
    values, vectors = np.linalg.eigh(s * root[:, None] * root)
    want = root[:, None] * vectors[:, np.argsort(-values)][:, 1:3]
    have = np.array([got[i] for i in ids])
    a, b = np.linalg.qr(want)[0], np.linalg.qr(have)[0]
    cosines = np.linalg.svd(a.T @ b)[1]
    assert np.allclose(cosines, 1.0, atol=1e-4), (cosines, np.sort(values)[::-1][:6])


def test_spectral_kmeans_keeps_blocks_together(spark):
    from quire.operators import spectral as sp

    c = planted(spark, blocks=3, per_block=8)
    centroids, part = sp.spectral_kmeans(tied(spark, c), c.docs, 18, 2, seed=3)
    assert part.count() == 24
    truth = c.docs.select("doc_id", F.col("label").cast("int").alias("class_idx"))
    assert partition_scores(part.join(truth, "doc_id"), ["k"]).first()["ari"] > 0.3  # two clusters of three blocks: at most 0.55
    assert centroids.select("topic").distinct().count() == part.select("topic").distinct().count()


def _themes(spark, k=3, docs=90, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(docs):
        share = rng.dirichlet([0.05] * k)
        for t in rng.choice(k, 60, p=share):
            rows.append((d, int(t * 20 + rng.integers(0, 20)), int(share.argmax())))
    df = spark.createDataFrame(rows, "doc_id long, term_idx int, label int")
    counts = df.groupBy("doc_id", "term_idx").agg(F.count(F.lit(1)).alias("count"))
    return counts, df.select("doc_id", F.col("label").alias("class_idx")).distinct()


def test_lda_finds_planted_themes_and_their_prior(spark):
    from quire.operators import lda as ld

    counts, classes = _themes(spark)
    mem = classes.select(F.lit("lda").alias("algo"), F.lit("reference").alias("kind"), F.explode(F.array(F.lit(3), F.lit(2))).alias("k"),
                         F.lit(0).alias("run"), "doc_id")
    weights, part, errors = ld.fit(counts, mem, spark.range(60), KEYS, max_iter=30, alpha=1.0, optimize_every=5, burn_in=10)
    assert errors.where("error is not null").count() == 0
    sums = {r["k"]: r for r in weights.groupBy("k").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).collect()}
    assert {k: r["n"] for k, r in sums.items()} == {2: 120, 3: 180} and all(abs(r["w"] - k) < 1e-9 for k, r in sums.items())
    three = part.where("k = 3")
    assert three.count() == 90 and partition_scores(three.join(classes, "doc_id"), KEYS).first()["ari"] > 0.9
    tops = ld.rerank(weights.where("k = 3"), KEYS).groupBy("topic").agg(F.max_by("term_idx", "weight").alias("t")).collect()
    assert len({r["t"] // 20 for r in tops}) == 3


def test_lda_of_a_model_without_terms_has_an_error(spark):
    from quire.operators import lda as ld

    counts, _ = _themes(spark, docs=20)
    mem = spark.createDataFrame([("lda", "run", 2, r, d) for r, d in [(1, 1), (1, 2), (2, 900)]], "algo string, kind string, k int, run int, doc_id long")
    weights, part, errors = ld.fit(counts, mem, spark.range(60), KEYS, max_iter=2, top=5)
    assert {r["run"]: r["error"] is None for r in errors.collect()} == {1: True, 2: False}
    assert part.count() == 3 and weights.count() == 2 * 2 * 5


def test_digamma_and_prior():
    from quire.operators import lda as ld

    assert np.allclose(ld.digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649015329, -1.9635100260214235, 2.251752589066721])
    rng = np.random.default_rng(1)
    true = np.array([0.3, 2.0, 0.7])
    n = np.stack([rng.multinomial(400, rng.dirichlet(true)) for _ in range(3000)])
    alpha = np.ones(3)
    for _ in range(300):
        small = np.concatenate([ld.digamma(n + alpha).sum(0), [ld.digamma((n.sum(1) + alpha.sum())).sum(), len(n)]])
        alpha = ld._next_alpha(alpha, small)
    assert np.allclose(alpha, true, rtol=0.1)


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_sparse_distances_are_those_of_dense_rows(spark, monkeypatch, block):
    monkeypatch.setattr("quire.operators.blocks.BLOCK_BYTES", block)
    rng = np.random.default_rng(3)
    x = np.where(rng.random((12, 30)) < 0.3, rng.normal(size=(12, 30)), 0)
    c = np.where(rng.random((3, 30)) < 0.5, rng.normal(size=(3, 30)), 0)
    x[0], c[2, :29] = 0, 0
    x[1] = rng.random(30)  # holds every term
    rows, mem = _rows(spark, x, (3,))
    centres = spark.createDataFrame([("a", "b", 3, 0, j, t, float(v)) for (j, t), v in np.ndenumerate(c) if v],
                                    "algo string, kind string, k int, run int, topic int, term_idx int, weight double")
    got = km.sparse_distances(rows, mem, centres, KEYS).collect()
    assert len(got) == 36
    for r in got:
        u, v = x[r["doc_id"]], c[r["topic"]]
        size = np.linalg.norm(u) * np.linalg.norm(v)
        gap = np.abs(u - v)
        want = (1 - u @ v / size if size else 1.0, np.linalg.norm(gap), gap.sum(), gap.max(), (gap ** 3).sum() ** (1 / 3))
        assert np.allclose([r[m] for m in km.SPARSE_METRICS], want)
