"""Text functions and the document-term table on small inputs."""

from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import vectorize as vz


def test_normalize_and_tokenize(spark):
    df = spark.createDataFrame(
        [(1, "  Héllo wörld http://x.y/z foo\n\nA\n1abc déjà_vu 2x ab\n  ")], "doc_id long, text string")
    r = df.select(tx.normalize_body(F.col("text")).alias("b")).select("b", tx.tokenize(F.col("b")).alias("t")).first()
    assert r["b"] == "Héllo wörld  foo\n1abc déjà_vu 2x ab\n"
    assert r["t"] == ["hello", "world", "foo", "deja_vu", "ab"]


def test_ngrams_and_stopwords(spark):
    df = spark.createDataFrame([(["a", "the", "b", "c"],)], "t array<string>")
    r = df.select(tx.ngrams(tx.remove_stopwords(F.col("t"), ["the"]), 1, 3).alias("g")).first()
    assert r["g"] == ["a", "b", "c", "a b", "b c", "a b c"]


def test_doc_identity(spark):
    label, doc_id = tx.doc_identity(F.col("p"))
    df = spark.createDataFrame([("/d/my class/x.y.txt",), ("/d/sport/sport_1.txt",), ("/d/a/.hidden",)], "p string")
    got = [(r[0], r[1]) for r in df.select(label, doc_id).collect()]
    assert got == [("my_class", "my_class_x.y"), ("sport", "sport_1"), ("a", "a_.hidden")]


def test_build_corpus_tfidf_l2(spark):
    docs = spark.createDataFrame(
        [(1, "x", "apple banana apple\n"), (2, "y", "banana cherry\n"), (3, "y", "cherry cherry apple\n")],
        "doc_id long, label string, body string")
    c = vz.build_corpus(docs, vz.CorpusConfig(min_df=2, tfidf=True, norm=True, min_doc_length=0))
    vocab = [r["term"] for r in c.vocab.orderBy("term_idx").collect()]
    assert vocab == ["apple", "banana", "cherry"]
    rows = c.doc_terms.collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], 0.0)
        by_doc[r["doc_id"]] += r["weight"] ** 2
    assert all(abs(v - 1.0) < 1e-12 for v in by_doc.values())
    tf = {(r["doc_id"], r["term"]): r["tf"] for r in rows}
    assert tf[(1, "apple")] == 2 and tf[(3, "cherry")] == 2


def test_ordered_index_is_dense(spark):
    from quire.operators.indexing import ordered_index

    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("x"), (F.col("id") % 3).alias("g"))
    out = ordered_index(df, ["x"], "pos", group_cols=["g"]).collect()
    for g in range(3):
        xs = sorted((r["x"], r["pos"]) for r in out if r["g"] == g)
        assert [p for _, p in xs] == list(range(len(xs)))
