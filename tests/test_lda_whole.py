"""The LDA queries do all iterations of the sampler, on rows that name their runs."""

import numpy as np
from test_models import KEYS, _themes, planted

from quire.operators import lda as ld
from quire.operators import packed as pk
from quire.plans import queries_lda as ql


def test_queries_fit_all_iterations(spark, monkeypatch):
    c = planted(spark, blocks=3, per_block=8)
    monkeypatch.setattr(ql, "corpus", lambda *a, **more: c)
    seen, fit = [], ld.fit
    monkeypatch.setattr(ql.ld, "fit", lambda *a, **more: seen.append((a, more)) or fit(*a, **{**more, "max_iter": 1}))
    got = ql.q_lda_fit(spark, "").collect()
    assert sorted((r["k"], r["run"], r["n_terms"]) for r in got) == [(k, r, 18) for k in (2, 3) for r in (0, 1)]
    (rows, members, *_), more = seen[0]
    assert more["max_iter"] == ld.SWEEP_ITERATIONS == 500 > ld.BURN_IN and not {"optimize_every", "burn_in", "sweeps"} & set(more)
    packed, _ = pk.pack(rows, members, KEYS)
    assert not any(x in packed._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Join", "Sort"))
    assert members.where("run = 0").count() == 48 and members.where("run = 1").count() == 2 * int(0.8 * 24)


def test_prior_is_estimated_where_its_iterations_are_reached(spark):
    counts, classes = _themes(spark, docs=40)
    members = classes.selectExpr("'lda' AS algo", "'reference' AS kind", "2 AS k", "0 AS run", "doc_id")
    priors = []
    for iterations in (5, 6):
        _, _, done = ld._models(counts, members, spark.range(60), KEYS, iterations, 1, 10.0, 0.01, 3, 2, 5)
        priors.append(done[0][2][0][0])
    assert priors[0].tolist() == [5.0, 5.0] and not np.allclose(priors[1], 5.0, atol=1e-3)


def test_shares_settle_token_by_token():
    rng = np.random.default_rng(2)
    n, k, terms = 60, 3, 20
    ends = np.array([0, 25, 25, 60])
    for weights in (rng.integers(1, 4, n).astype(float), np.ones(n)):
        rows = pk.Rows(None, ends, rng.integers(0, terms, n), weights, (np.zeros(0, int), np.zeros(0, int)))
        counts, alpha = rng.random((k, terms)) * 9, np.array([1.0, 3.0, 6.0])
        mass = counts.sum(1)
        share, expected = ld._shares(rows, counts, (alpha, mass, 0.01, terms), 3)
        g, doc = np.full((k, n), 1 / k), np.repeat(np.arange(4), np.diff(ends, prepend=0))
        for _ in range(3):
            e = np.stack([np.bincount(doc, x * weights, 4) for x in g])
            g = (e[:, doc] - g + alpha[:, None]) * ((counts + 0.01) / (mass + terms * 0.01)[:, None])[:, rows.terms]
            g /= g.sum(0)
        assert np.allclose(share, g) and np.allclose(expected, [np.bincount(doc, x * weights, 4) for x in g])
