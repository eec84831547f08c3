"""Documents' rows with lists: terms indexed inside the row, and the passes that read them."""

import numpy as np
from pyspark.sql import functions as F

from quire.operators import centroids as ce
from quire.operators import lookup as lk
from quire.operators import nmf as nm
from quire.operators import vectorize as vz
from quire.plans import partition_stability as ps
from quire.plans.catalog import QUERIES

KEYS = ["algo", "kind", "k", "run"]


def corpus(spark, n=30):
    rows = [(i, f"c{i % 3}", " ".join(f"w{(i * j) % 11}" for j in range(1, 9)) if i % 7 else "1 2") for i in range(n)]
    return vz.build_corpus(spark.createDataFrame(rows, "doc_id long, label string, body string"), vz.CorpusConfig(min_df=2, tfidf=True, norm=True))


def test_pairs_are_indexed_and_normalised_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lk, "SHARD_TERMS", 2)  # many files, some without terms
    c = corpus(spark)
    plan = c.cells()._jdf.queryExecution().executedPlan().toString() + vz.weigh_rows(
        c.counted, c.vocab, c.config)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Window", "Join"))
    vocab = {r["term"]: (r["term_idx"], r["idf"]) for r in c.vocab.collect()}
    want = {}
    for r in c.counted.collect():
        w = {vocab[t][0]: n * vocab[t][1] for t, n in zip(r["words"] or [], r["tfs"] or []) if t in vocab}
        want |= {(r["doc_id"], t): x / np.sqrt(sum(v * v for v in w.values())) for t, x in w.items()}
    got = {(r["doc_id"], r["term_idx"]): r["weight"] for r in c.cells().collect()}
    assert len(want) > 50 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert c.rows.count() == c.docs.count() == 30


def test_tfidf_has_a_row_for_each_pair(spark, tmp_path):
    text = "apple banana cherry apple, a text of more than fifty characters altogether"
    docs = spark.createDataFrame([(i, text, "en", "s", len(text)) for i in range(25)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["tfidf"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "term_idx", "weight"] and got.count() == 25 * 9


def test_centroids_of_rows_with_lists_equal_those_of_pairs(spark):
    c = corpus(spark)
    part = c.docs.select("doc_id", (F.col("doc_id") % 2).alias("topic"))
    one, two = ({(r["topic"], r["term_idx"]): r["weight"] for r in ce.build_centroids(x, part, []).collect()} for x in (c.rows, c.doc_terms))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-12 for k in one)


def test_class_folds_add_up_all_runs_in_one_aggregate(spark):
    plan = ps.class_fold_centroids(corpus(spark), 2, 3, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(CASE WHEN _o1" in plan and "sum(CASE WHEN _o2" in plan


def test_nmf_steps_of_rows_with_lists(spark):
    c = corpus(spark)
    mem = c.docs.select(F.lit("nmf").alias("algo"), F.lit("reference").alias("kind"), F.lit(2).alias("k"), F.lit(0).alias("run"), "doc_id")
    W, H = nm.random_start(mem, c.vocab, KEYS)
    x = np.zeros((30, c.vocab.count()))
    for r in c.cells().collect():
        x[r["doc_id"], r["term_idx"]] = r["weight"]
    w, h = np.zeros((30, 2)), np.zeros((2, x.shape[1]))
    for r in W.collect():
        w[r["doc_id"], r["topic"]] = r["w"]
    for r in H.collect():
        h[r["topic"], r["term_idx"]] = r["h"]
    ratio = np.where(x > 0, x / (w @ h + nm.EPS), 0)
    want = {"fro": h * (w.T @ x) / (w.T @ w @ h + nm.EPS), "kl": h * (w.T @ ratio) / (w.sum(0)[:, None] + nm.EPS)}
    for rows in (c.rows, c.doc_terms):
        X = nm.model_rows(rows, mem, KEYS)
        for kind, new in (("fro", nm.update_h(X, W, H, KEYS)), ("kl", nm.update_h_kl(X, W, H, KEYS))):
            assert all(abs(want[kind][r["topic"], r["term_idx"]] - r["h"]) < 1e-9 for r in new.collect())
    new = nm.update_w(nm.model_rows(c.rows, mem, KEYS), W, H, KEYS).collect()
    assert len(new) == 60 and all(abs((w * (x @ h.T) / (w @ h @ h.T + nm.EPS))[r["doc_id"], r["topic"]] - r["w"]) < 1e-9 for r in new)
