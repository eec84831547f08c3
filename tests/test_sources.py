"""Files, stopwords, line exports."""

from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import vectorize as vz
from quire.sources import files, store


def test_scan_keeps_names_with_spaces_and_drops_bad_bytes(spark, tmp_path):
    folder = tmp_path / "my class"
    folder.mkdir()
    (folder / "a.b.txt").write_bytes(b"some \xff text")
    (folder / "50%+x.txt").write_bytes("é".encode())
    (folder / ".hidden.txt").write_text("no")
    got = {r["doc_id"]: (r["label"], r["text"]) for r in files.scan_documents(spark, [str(tmp_path)]).collect()}
    assert got == {"my_class_a.b": ("my_class", "some  text"), "my_class_50%+x": ("my_class", "é")}


def test_stopwords_are_a_table_of_any_size(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("The\n the \n\nAND\n")
    words = files.load_stopwords(spark, str(tmp_path / "stop.txt"))
    assert sorted(r["term"] for r in words.collect()) == ["and", "the"]
    docs = spark.createDataFrame([(1, "a", "the cat and the dog"), (2, "a", "cat")], "doc_id long, label string, body string")
    corpus = vz.build_corpus(docs, vz.CorpusConfig(stopwords=words, min_df=1))
    assert sorted(r["term"] for r in corpus.vocab.collect()) == ["cat", "dog"]


def test_min_df_as_a_share_and_errors(spark):
    docs = spark.createDataFrame([(i, "a", "both " + ("rare" if i == 0 else "")) for i in range(4)], "doc_id long, label string, body string")
    corpus = vz.check_corpus(vz.build_corpus(docs, vz.CorpusConfig(min_df=0.5)))
    assert [r["term"] for r in corpus.vocab.collect()] == ["both"]
    corpus.release()
    for bad, error in ((vz.build_corpus(docs, vz.CorpusConfig(min_df=9)), vz.EmptyVocabularyError),
                       (vz.build_corpus(docs.union(docs.limit(1)), vz.CorpusConfig(min_df=1)), vz.DuplicateDocumentError)):
        try:
            vz.check_corpus(bad)
        except error:
            continue
        raise AssertionError(error)


def test_counts_in_the_row_match_an_aggregate_and_need_no_exchange(spark):
    docs = spark.createDataFrame([(i, "a", " ".join(f"w{(i * j) % 7}" for j in range(30))) for i in range(20)], "doc_id long, label string, body string")
    cfg = vz.CorpusConfig(min_df=1)
    counted = vz.doc_term_counts(docs, cfg)
    plain = vz.doc_tokens(docs, cfg).select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(
        F.count(F.lit(1)).alias("tf"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, plain.collect()))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_accents_decomposed_and_ligatures(spark):
    rows = [("résumé ﬁnance",), ("Ünïçødé Ĳssel",), ("plain",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(tx.fold_accents(F.col("t"))).collect()]
    assert got == ["resume finance", tx.strip_accents_exact("ünïçødé ĳssel"), "plain", None]


def test_lines_are_written_in_order(spark, tmp_path):
    vocab = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], "term_idx int, term string")
    store.write_lines(store.term_lines(vocab), str(tmp_path / "x.terms"), ["row"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "x.terms")).collect()] == ["a", "b", "c"]
    docs = spark.createDataFrame([("d2",), ("d1",)], "doc_id string")
    assert [(r["row"], r["line"]) for r in store.doc_lines(docs).orderBy("row").collect()] == [(0, "d1"), (1, "d2")]
