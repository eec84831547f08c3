"""Queries for sources, text functions and the vector-space model (A, B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import vectorize as vz
from . import oracle_sql as O
from .catalog import COUNT_CFG, MATRIX_CFG, corpus, i64, query, r6, table

STOP_SQL = O.sql_list(O.QUERY_STOPWORDS)


@query("normalize_body", sql=f"""
WITH {O.docs_cte(min_len=0)}
SELECT CAST(doc_id AS BIGINT) AS doc_id, body, CAST(length(body) AS BIGINT) AS n_chars FROM docs""")
def normalize_body(spark, sf_dir):
    """C1 + C2 on every document (no length filter)."""
    d = vz.prepare_documents(table(spark, sf_dir, "documents"), min_length=0)
    return d.select(i64("doc_id").alias("doc_id"), "body", i64(F.length("body")).alias("n_chars"))


@query("read_text", sql=r"""
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT doc_id, generate_subscripts(kept, 1) AS line_no, unnest(kept) AS line FROM (
    SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
             lambda l: regexp_replace(regexp_replace(l, '^\s+|\s+$', '', 'g'), 'https?[:;]?/?/?\S*', '', 'g')),
           lambda l: length(l) > 1) AS kept
    FROM documents) s) t""")
def read_text(spark, sf_dir):
    """A2: the kept lines of every document with their position."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(tx.body_lines(F.col("text"))).alias("pos", "line")).select(
        i64("doc_id").alias("doc_id"), i64(F.col("pos") + 1).alias("line_no"), "line")


@query("strip_uris", sql=r"""
SELECT CAST(page_id AS BIGINT) AS page_id,
       regexp_replace(regexp_replace(url, '^\s+|\s+$', '', 'g'), 'https?[:;]?/?/?\S*', '', 'g') AS stripped,
       regexp_replace(regexp_replace('see ' || url || ' now', '^\s+|\s+$', '', 'g'), 'https?[:;]?/?/?\S*', '', 'g') AS in_line
FROM pages""")
def strip_uris(spark, sf_dir):
    """C1 on pages.url (every url is a URI) and on a line that embeds it."""
    p = table(spark, sf_dir, "pages")
    return p.select(i64("page_id").alias("page_id"), tx.strip_uris(F.col("url")).alias("stripped"),
                    tx.strip_uris(F.concat(F.lit("see "), F.col("url"), F.lit(" now"))).alias("in_line"))


@query("doc_identity", sql=r"""
WITH p AS (
  SELECT page_id, replace(regexp_extract(url, '([^/]*)/[^/]*$', 1), ' ', '_') AS label,
         regexp_extract(url, '([^/]*)$', 1) AS base FROM pages),
q AS (SELECT *, regexp_extract(base, '^(\.*)', 1) AS lead FROM p),
r AS (SELECT *, substr(base, length(lead) + 1) AS rest FROM q),
s AS (SELECT page_id, label,
             CASE WHEN contains(rest, '.') THEN lead || regexp_replace(rest, '\.[^.]*$', '') ELSE base END AS stem
      FROM r)
SELECT CAST(page_id AS BIGINT) AS page_id, label,
       CASE WHEN starts_with(stem, label) THEN stem ELSE label || '_' || stem END AS doc_id
FROM s""")
def doc_identity(spark, sf_dir):
    """B1: label and id of a document from its path (pages.url as a path)."""
    p = table(spark, sf_dir, "pages")
    label, doc_id = tx.doc_identity(F.col("url"))
    return p.select(i64("page_id").alias("page_id"), label.alias("label"), doc_id.alias("doc_id"))


@query("min_length_docs", sql=f"""
WITH {O.docs_cte(min_len=0)}
SELECT CAST(count(*) FILTER (WHERE length(body) >= {O.MIN_DOC_LENGTH}) AS BIGINT) AS kept,
       CAST(count(*) FILTER (WHERE length(body) < {O.MIN_DOC_LENGTH}) AS BIGINT) AS skipped
FROM docs""")
def min_length_docs(spark, sf_dir):
    """B2: documents kept and skipped by the minimum-length filter."""
    return vz.length_filter_counts(table(spark, sf_dir, "documents"), min_length=O.MIN_DOC_LENGTH)


@query("class_counts", sql=f"""
WITH {O.docs_cte()}
SELECT label, CAST(count(*) AS BIGINT) AS n_docs, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_ids,
       (SELECT count(DISTINCT label) FROM docs WHERE label IS NOT NULL) >= 2 AS has_ground_truth
FROM docs WHERE label IS NOT NULL GROUP BY label""")
def class_counts(spark, sf_dir):
    """Per-class document counts and the ground-truth guard."""
    docs = vz.prepare_documents(table(spark, sf_dir, "documents"), label_col="lang")
    return vz.class_counts(docs)


@query("fold_accents", sql="""
SELECT CAST(doc_id AS BIGINT) AS doc_id, strip_accents(lower(text)) AS folded FROM documents""")
def fold_accents(spark, sf_dir):
    """Lowercase + accent removal of every text."""
    d = table(spark, sf_dir, "documents")
    return d.select(i64("doc_id").alias("doc_id"), tx.fold_accents(F.col("text")).alias("folded"))


def _tokens_sql(extra_filter: str = "") -> str:
    return rf"""
WITH {O.docs_cte()},
t AS (SELECT doc_id, list_filter(regexp_extract_all(strip_accents(lower(body)), '[\p{{L}}\p{{N}}_]{{2,}}'),
                                 lambda x: regexp_matches(x, '^\p{{L}}') {extra_filter}) AS toks FROM docs)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(toks) AS BIGINT) AS n_tokens,
       array_to_string(toks, ' ') AS tokens FROM t"""


@query("tokenize", sql=_tokens_sql())
def tokenize(spark, sf_dir):
    """C4: tokens of every kept document, in order."""
    docs = vz.prepare_documents(table(spark, sf_dir, "documents"))
    toks = tx.tokenize(F.col("body"))
    return docs.select(i64("doc_id").alias("doc_id"), i64(F.size(toks)).alias("n_tokens"),
                       F.array_join(toks, " ").alias("tokens"))


@query("remove_stopwords", sql=_tokens_sql(f"AND x NOT IN ({STOP_SQL})"))
def remove_stopwords(spark, sf_dir):
    """Tokens without the stopword list, order kept."""
    docs = vz.prepare_documents(table(spark, sf_dir, "documents"))
    toks = tx.remove_stopwords(tx.tokenize(F.col("body")), list(O.QUERY_STOPWORDS))
    return docs.select(i64("doc_id").alias("doc_id"), i64(F.size(toks)).alias("n_tokens"),
                       F.array_join(toks, " ").alias("tokens"))


@query("ngrams", sql=rf"""
WITH {O.docs_cte()},
t AS (SELECT doc_id, list_filter(regexp_extract_all(strip_accents(lower(body)), '[\p{{L}}\p{{N}}_]{{2,}}'),
                                 lambda x: regexp_matches(x, '^\p{{L}}') AND x NOT IN ({STOP_SQL})) AS toks FROM docs),
g AS (SELECT doc_id, unnest(toks) AS gram FROM t
      UNION ALL
      SELECT doc_id, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) AS gram
      FROM t WHERE len(toks) >= 2)
SELECT gram, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM g GROUP BY gram""")
def ngrams(spark, sf_dir):
    """Unigrams and bigrams (after stopwords): occurrences and df."""
    cfg = vz.CorpusConfig(stopwords=O.QUERY_STOPWORDS, ngram_range=(1, 2))
    docs = vz.prepare_documents(table(spark, sf_dir, "documents"))
    tf = vz.doc_term_counts(docs, cfg)
    return tf.groupBy(F.col("term").alias("gram")).agg(
        i64(F.sum("tf")).alias("n"), i64(F.count(F.lit(1))).alias("df"))


@query("term_frequency", sql=f"""
WITH {O.docs_cte()}, {O.tokens_cte()}
SELECT CAST(doc_id AS BIGINT) AS doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM toks GROUP BY doc_id, term""")
def term_frequency(spark, sf_dir):
    """Raw count of every (document, term)."""
    docs = vz.prepare_documents(table(spark, sf_dir, "documents"))
    tf = vz.doc_term_counts(docs, vz.CorpusConfig())
    return tf.select(i64("doc_id").alias("doc_id"), "term", i64("tf").alias("tf"))


@query("document_frequency", sql=f"""
WITH {O.matrix_ctes()}
SELECT term, df FROM dfq WHERE df >= {O.MIN_DF}""")
def document_frequency(spark, sf_dir):
    """Document frequency of the terms kept by min_df."""
    docs = vz.prepare_documents(table(spark, sf_dir, "documents"))
    df = vz.document_frequency(vz.doc_term_counts(docs, COUNT_CFG))
    return df.where(F.col("df") >= O.MIN_DF).select("term", i64("df").alias("df"))


@query("vocabulary", sql=f"""
WITH {O.matrix_ctes()}
SELECT CAST(term_idx AS BIGINT) AS term_idx, term, df, round(idf, 6) AS idf FROM vocab""")
def vocabulary(spark, sf_dir):
    """Vocabulary in lexicographic order with df and idf."""
    c = corpus(spark, sf_dir, cfg=COUNT_CFG)
    return c.vocab.select(i64("term_idx").alias("term_idx"), "term", i64("df").alias("df"), r6("idf").alias("idf"))


@query("tfidf", sql=f"""
WITH {O.matrix_ctes(norm=False)}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(term_idx AS BIGINT) AS term_idx, round(weight, 6) AS weight FROM dt""")
def tfidf(spark, sf_dir):
    """Tf * (ln((1+n)/(1+df)) + 1)."""
    c = corpus(spark, sf_dir, cfg=vz.CorpusConfig(stopwords=O.QUERY_STOPWORDS, min_df=O.MIN_DF, tfidf=True))
    return c.cells().select(i64("doc_id").alias("doc_id"), i64("term_idx").alias("term_idx"),
                            r6("weight").alias("weight"))


@query("l2_normalize", sql=f"""
WITH {O.matrix_ctes(tfidf=False, norm=True)}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(term_idx AS BIGINT) AS term_idx, round(weight, 6) AS weight FROM dt""")
def l2_normalize(spark, sf_dir):
    """C11: raw counts scaled to unit Euclidean length per document."""
    c = corpus(spark, sf_dir, cfg=vz.CorpusConfig(stopwords=O.QUERY_STOPWORDS, min_df=O.MIN_DF, norm=True))
    return c.cells().select(i64("doc_id").alias("doc_id"), i64("term_idx").alias("term_idx"),
                              r6("weight").alias("weight"))


@query("document_term_matrix", sql=f"""
WITH {O.matrix_ctes()}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(term_idx AS BIGINT) AS term_idx, CAST(tf AS BIGINT) AS tf,
       round(weight, 6) AS weight FROM dt""")
def document_term_matrix(spark, sf_dir):
    """The full preprocessing (stopwords, min_df, TF-IDF, L2)."""
    c = corpus(spark, sf_dir, cfg=MATRIX_CFG)
    return c.cells().select(i64("doc_id").alias("doc_id"), i64("term_idx").alias("term_idx"),
                              i64("tf").alias("tf"), r6("weight").alias("weight"))
