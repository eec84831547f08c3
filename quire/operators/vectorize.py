"""Vector-space model: documents -> document-term table.

Plan shape (see ``build_corpus``):

    scan -> normalise body -> length filter -> tokens
         -> sorted tokens -> run lengths, inside the document row      = counted rows (written once)
    counted -> partial/final count by term (small shuffle)             = df
    df -> min_df + stopwords -> ordered index (range sort)             = vocab (written once)
    counted x vocab, looked up inside the row (``lookup``); weights and L2 norm in place = rows (written once)
    rows -> explode                                                    = (document, term) pairs

(document, term) pairs never leave their document's row: they are neither shuffled
nor sorted, to be counted, indexed or normalised; the plan is the same at every size.
Stopwords of a unigram model are removed from the vocabulary (same result, far fewer
rows than removing per token).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from threading import RLock

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import scratch_path
from ..sources.files import deal
from . import lookup as lk
from .indexing import ordered_index
from .packed import explode_rows
from .sampling import run_rows


@dataclass(frozen=True)
class CorpusConfig:
    """Options of the reference's preprocessing, with its CLI defaults."""

    min_doc_length: int = tx.DEFAULT_MIN_DOC_LENGTH
    stopwords: tuple[str, ...] | DataFrame = ()  # words, or (unigrams only) a table with a column term
    min_df: float = 20  # a number of documents, or their share if below 1
    min_term_length: int = 2
    ngram_range: tuple[int, int] = (1, 1)
    tfidf: bool = False
    norm: bool = False
    exact_fold: bool = False


@dataclass
class Corpus:
    docs: DataFrame        # doc_id, label (kept documents)
    vocab: DataFrame       # term_idx, term, df, idf
    counted: DataFrame | None  # doc_id, label, words, tfs: the distinct terms of each document and their counts
    config: CorpusConfig = field(default_factory=CorpusConfig)
    held: list[str] = field(default_factory=list)  # folders that building the corpus wrote
    samples: dict[tuple, DataFrame] = field(default_factory=dict)
    lock: RLock = field(default_factory=RLock)

    @cached_property
    def rows(self) -> DataFrame:
        """doc_id, label, terms, tfs, weights: a row a document, the arrays in the order of the vocabulary; written when first read."""
        self.held.append(scratch_path(self.vocab.sparkSession, "rows"))
        weigh_rows(self.counted, self.vocab, self.config).write.parquet(self.held[-1])
        return self.vocab.sparkSession.read.parquet(self.held[-1])

    def sampled(self, runs: int, ratio: float, seed: int) -> DataFrame:
        """``rows`` with the ``runs`` that each document is in; where a run's sample ends is found when first asked for."""
        with self.lock:
            if (runs, ratio, seed) not in self.samples:
                self.samples[runs, ratio, seed] = run_rows(self.rows, self.docs, runs, ratio, seed)
            return self.samples[runs, ratio, seed]

    def cells(self) -> DataFrame:
        """doc_id, term_idx, tf, weight: the pairs of ``rows``."""
        return explode_rows(self.rows, ["doc_id"], {"terms": "term_idx", "tfs": "tf", "weights": "weight"})

    @property
    def doc_terms(self) -> DataFrame:
        """The pairs with their ``term``, which costs a join of all of them: models and exports read ``rows`` or ``cells``."""
        return self.cells().join(self.vocab.select("term_idx", "term"), "term_idx").select("doc_id", "term_idx", "term", "tf", "weight")

    def settle(self) -> "Corpus":
        """Write ``rows``, take the list of documents from them and give up the counted documents, whose words take more room.
        For a corpus whose ``docs`` nothing has taken yet; ``counted`` is gone after that."""
        self.docs, self.counted = self.rows.select("doc_id", "label"), None
        lk.drop(self.held[0])
        return self

    def release(self) -> None:
        """Give up everything that building the corpus wrote."""
        for folder in self.held:
            lk.drop(folder)


def prepare_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      label_col: str | None = "lang",
                      min_length: int = tx.DEFAULT_MIN_DOC_LENGTH) -> DataFrame:
    """B2 + C1/C2: normalised bodies of at least ``min_length`` characters."""
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    src = deal(df.select(F.col(id_col).alias("doc_id"), label.alias("label"), F.col(text_col).alias("_text")))
    # A filter on the computed body would be pushed below it, and every text normalised twice.
    body = F.filter(F.array(tx.normalize_body(F.col("_text"))), lambda b: F.length(b) >= min_length)
    return src.select("doc_id", "label", F.explode_outer(body).alias("body")).where("body is not null")


def document_list(df: DataFrame, label_col: str | None = "lang", min_length: int = tx.DEFAULT_MIN_DOC_LENGTH) -> DataFrame:
    """B2: (doc_id, label) of the kept documents, persisted: samples and classes read it many times, the texts once."""
    return prepare_documents(df, label_col=label_col, min_length=min_length).select("doc_id", "label").persist(StorageLevel.MEMORY_AND_DISK)


def length_filter_counts(df: DataFrame, text_col: str = "text",
                         min_length: int = tx.DEFAULT_MIN_DOC_LENGTH) -> DataFrame:
    """B2 bookkeeping: kept and skipped documents, one aggregate."""
    ok = F.length(tx.normalize_body(F.col(text_col))) >= min_length
    return df.agg(F.count_if(ok).cast("bigint").alias("kept"),
                  F.count_if(~ok).cast("bigint").alias("skipped"))


def token_column(cfg: CorpusConfig) -> Column:
    """Tokens of ``body`` after folding, tokenising and (for n-grams) stopwords."""
    toks = tx.tokenize(F.col("body"), cfg.min_term_length, cfg.exact_fold)
    n_min, n_max = cfg.ngram_range
    return tx.ngrams(tx.remove_stopwords(toks, list(cfg.stopwords)), n_min, n_max) if n_max > 1 else toks


def doc_tokens(docs: DataFrame, cfg: CorpusConfig) -> DataFrame:
    return docs.select("doc_id", token_column(cfg).alias("tokens"))


def _counted(docs: DataFrame, cfg: CorpusConfig, *kept: str) -> DataFrame:
    """One row a document: its distinct terms in order (``words``) and their counts (``tfs``)."""
    sizes = F.size("_s")
    ordered = docs.withColumn("_s", F.sort_array(token_column(cfg))).select(*kept, "_s")
    # No filter on the tokens either: documents without any get no pairs.
    ends = F.when(sizes > 0, F.filter(F.sequence(F.lit(1), sizes), lambda i: (i == sizes) | (F.get("_s", i - 1) != F.get("_s", i))))
    counts = F.transform("_e", lambda e, j: (e - F.coalesce(F.when(j > 0, F.get("_e", j - 1)), F.lit(0))).cast("bigint"))
    return ordered.withColumn("_e", ends).select(*kept, F.transform("_e", lambda e: F.get("_s", e - 1)).alias("words"), counts.alias("tfs"))


def doc_term_counts(docs: DataFrame, cfg: CorpusConfig) -> DataFrame:
    """(doc_id, term, tf), counted inside each document's row: the ends of
    the runs of equal tokens in the sorted token array give the counts."""
    return explode_rows(_counted(docs, cfg, "doc_id"), ["doc_id"], {"words": "term", "tfs": "tf"})


def document_frequency(doc_tf: DataFrame) -> DataFrame:
    """C8 (first half): df per term; map-side partial counts absorb hot terms."""
    return doc_tf.groupBy("term").agg(F.count(F.lit(1)).cast("bigint").alias("df"))


def _stopword_frame(spark, words) -> DataFrame:
    if isinstance(words, DataFrame):
        return words
    rows = sorted({w.strip().lower() for w in words if w and w.strip()})
    return spark.createDataFrame([(w,) for w in rows], "term string")


def vocabulary(df_table: DataFrame, n_docs: DataFrame, cfg: CorpusConfig) -> DataFrame:
    """C8 + C9 + idf: terms with df >= min_df (minus stopwords), indexed in
    lexicographic order. ``n_docs`` is a one-row, one-column frame."""
    least = F.lit(cfg.min_df) if cfg.min_df >= 1 else F.lit(float(cfg.min_df)) * n_docs.scalar()
    kept = df_table.where(F.col("df") >= least)
    if (isinstance(cfg.stopwords, DataFrame) or cfg.stopwords) and cfg.ngram_range[1] == 1:
        kept = kept.join(_stopword_frame(df_table.sparkSession, cfg.stopwords), "term", "left_anti")
    n = n_docs.scalar()  # scalar subquery, evaluated once
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    kept = kept.withColumn("idf", idf)
    return ordered_index(kept, ["term"], "term_idx").select(
        F.col("term_idx").cast("int").alias("term_idx"), "term", "df", "idf"
    )


def weigh_rows(counted: DataFrame, vocab: DataFrame, cfg: CorpusConfig) -> DataFrame:
    """C10 + C11: each document's terms looked up in the vocabulary and weighted inside its row; with ``norm``
    the weights are divided by the row's Euclidean norm."""
    return lk.index_rows(counted, lk.publish(vocab), cfg.tfidf, cfg.norm)


class EmptyVocabularyError(ValueError):
    """No term is left after pruning."""


class DuplicateDocumentError(ValueError):
    """A document id occurs more than once."""


def check_corpus(corpus: Corpus) -> Corpus:
    """Fail on repeated document ids and on an empty vocabulary."""
    twice = corpus.docs.groupBy("doc_id").count().where("count > 1").first()
    if twice is not None:
        raise DuplicateDocumentError(f"document id {twice['doc_id']!r} occurs {twice['count']} times")
    if corpus.vocab.isEmpty():
        raise EmptyVocabularyError("no terms remain: lower min_df or the minimum document length")
    return corpus


def build_corpus(docs: DataFrame, cfg: CorpusConfig = CorpusConfig()) -> Corpus:
    """The whole preprocessing; counted documents, vocabulary and (when first read) indexed rows are written to
    the shared folder (``Corpus.release`` removes them). ``check_corpus`` validates the result.

    The text is read, normalised and tokenised once. The list of documents and the (document, term) pairs are
    projections of a row a document.
    """
    spark = docs.sparkSession
    held = [scratch_path(spark, "counted"), scratch_path(spark, "vocabulary")]
    _counted(docs, cfg, "doc_id", "label").write.parquet(held[0])
    counted = spark.read.parquet(held[0])
    doc_tf = counted.select(F.explode("words").alias("term"))
    n_docs = counted.agg(F.count(F.lit(1)).cast("bigint").alias("n_docs"))
    vocabulary(document_frequency(doc_tf), n_docs, cfg).write.parquet(held[1])
    return Corpus(docs=counted.select("doc_id", "label"), vocab=spark.read.parquet(held[1]), counted=counted, config=cfg, held=held)


def class_counts(docs: DataFrame) -> DataFrame:
    """Documents and distinct ids per label, and whether ground truth
    exists (at least two labels)."""
    per = docs.where(F.col("label").isNotNull()).groupBy("label").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_docs"),
        F.countDistinct("doc_id").cast("bigint").alias("n_ids"),
    )
    n_labels = per.agg(F.count(F.lit(1))).scalar()
    return per.select("label", "n_docs", "n_ids", (n_labels >= 2).alias("has_ground_truth"))
