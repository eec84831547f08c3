"""DuckDB SQL building blocks for the correctness oracle.

Each block is an independent re-statement of an operator in plain SQL over
the driver's views (documents, pages, labels, embeddings, ...). They are
used only to check the Spark queries; nothing in the library runs them.
"""

from __future__ import annotations

# Query parameters shared with the Spark catalog.
MIN_DOC_LENGTH = 50
MIN_DF = 20
SEED = 1000
RATIO = 0.8

# A short list of frequent function words, a parameter of the registered
# queries (the library takes any stopword list or file).
QUERY_STOPWORDS = (
    "the", "and", "of", "to", "in", "is", "it", "on", "for", "with", "as", "by", "at", "be", "this",
    "le", "la", "les", "des", "de", "du", "et", "en", "un", "une", "au", "aux",
    "der", "die", "das", "und", "el", "los", "las", "y",
)


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words)))


def docs_cte(label_col: str = "lang", min_len: int = MIN_DOC_LENGTH, name: str = "docs") -> str:
    """Normalised bodies: lines stripped, URIs removed, short lines dropped."""
    return rf"""{name} AS (
  SELECT doc_id, label, body FROM (
    SELECT doc_id, CAST({label_col} AS VARCHAR) AS label,
           CASE WHEN len(kept) > 0 THEN array_to_string(kept, chr(10)) || chr(10) ELSE '' END AS body
    FROM (SELECT doc_id, {label_col},
                 list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_replace(regexp_replace(l, '^\s+|\s+$', '', 'g'),
                                              'https?[:;]?/?/?\S*', '', 'g')),
                   lambda l: length(l) > 1) AS kept
          FROM documents) s) b
  WHERE length(body) >= {min_len})"""


def tokens_cte(src: str = "docs", name: str = "toks") -> str:
    return rf"""{name} AS (
  SELECT doc_id, term FROM (
    SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(body)), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term
    FROM {src}) t
  WHERE regexp_matches(term, '^\p{{L}}'))"""


def matrix_ctes(label_col: str = "lang", min_df: int = MIN_DF, stopwords=QUERY_STOPWORDS,
                tfidf: bool = True, norm: bool = True) -> str:
    """docs, toks, tf, dfq, ndocs, vocab, dt (doc_id, term_idx, term, tf, weight)."""
    stop = f"AND term NOT IN ({sql_list(stopwords)})" if stopwords else ""
    w = "tf.tf * v.idf" if tfidf else "CAST(tf.tf AS DOUBLE)"
    if norm:
        dt = f"""dt0 AS (SELECT tf.doc_id, v.term_idx, v.term, tf.tf, {w} AS weight
                FROM tf JOIN vocab v USING (term)),
dt AS (SELECT doc_id, term_idx, term, tf,
              weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS weight FROM dt0)"""
    else:
        dt = f"""dt AS (SELECT tf.doc_id, v.term_idx, v.term, tf.tf, {w} AS weight
               FROM tf JOIN vocab v USING (term))"""
    return f"""{docs_cte(label_col)},
{tokens_cte()},
tf AS MATERIALIZED (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM toks GROUP BY doc_id, term),
dfq AS MATERIALIZED (SELECT term, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY term),
ndocs AS (SELECT CAST(count(*) AS BIGINT) AS n FROM docs),
vocab AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_idx, term, df,
                 ln((1 + n) / (1 + df)) + 1 AS idf
          FROM dfq, ndocs WHERE df >= {min_df} {stop}),
{dt}"""


def members_cte(runs: int, ratio: float = RATIO, seed: int = SEED, src: str = "docs",
                name: str = "members") -> str:
    """run 0 = all documents; runs 1..r = first floor(ratio*n) in md5 order."""
    return f"""{name} AS (
  SELECT 0 AS run, doc_id FROM {src}
  UNION ALL
  SELECT run, doc_id FROM (
    SELECT r.run, d.doc_id,
           row_number() OVER (PARTITION BY r.run
                              ORDER BY md5(concat_ws(':', '{seed}', r.run, d.doc_id))) AS pos
    FROM {src} d, (SELECT CAST(range AS INTEGER) AS run FROM range(1, {runs} + 1)) r) x
  WHERE pos <= (SELECT floor({float(ratio)}::DOUBLE * count(*)) FROM {src}))"""


def class_idx_cte(src: str = "docs", name: str = "cls") -> str:
    return f"""{name} AS (
  SELECT doc_id, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS class_idx
  FROM {src} WHERE label IS NOT NULL)"""


def aj_ctes(a: str, b: str, key: list[str], name: str = "aj") -> str:
    """Average Jaccard of every (row topic of a, col topic of b) with equal key.

    a, b: key + topic, rank, term. Output: key + row, col, score.
    c_i = number of common terms with max(rank_a, rank_b) <= i;
    score = avg over i = 1..t of c_i / (2i - c_i), t = min(len a, len b).
    """
    k = ", ".join(key)
    on = " AND ".join(f"x.{c} = y.{c}" for c in key)
    kx = ", ".join(f"x.{c}" for c in key)
    kp = ", ".join(f"p.{c}" for c in key)
    onp = " AND ".join(f"p.{c} = c.{c}" for c in key)
    return f"""{name}_la AS (SELECT {k}, topic, count(*) AS len FROM {a} GROUP BY ALL),
{name}_lb AS (SELECT {k}, topic, count(*) AS len FROM {b} GROUP BY ALL),
{name}_pairs AS (SELECT {kx}, x.topic AS row, y.topic AS col, least(x.len, y.len) AS t
                 FROM {name}_la x JOIN {name}_lb y ON {on}),
{name}_common AS (SELECT {kx}, x.topic AS row, y.topic AS col, greatest(x.rank, y.rank) AS depth
                  FROM {a} x JOIN {b} y ON {on} AND x.term = y.term),
{name}_steps AS (SELECT {k}, row, col, t, unnest(range(1, t + 1)) AS i FROM {name}_pairs),
{name}_cnt AS (SELECT {kp}, p.row, p.col, p.t, p.i,
                      (SELECT count(*) FROM {name}_common c WHERE {onp} AND c.row = p.row AND c.col = p.col
                         AND c.depth <= p.i AND c.depth <= p.t) AS c
               FROM {name}_steps p),
{name} AS (SELECT {k}, row, col, avg(c / (2.0 * i - c)) AS score FROM {name}_cnt GROUP BY ALL)"""


def assignment_ctes(sim: str, key: list[str], name: str = "asg") -> str:
    """Maximum total score of a one-to-one matching (rows <= cols), enumerated
    with a recursive CTE and a bitmask of used columns. Rows must be 0..n-1."""
    k = ", ".join(key)
    ka = ", ".join(f"a.{c}" for c in key)
    on = " AND ".join(f"s.{c} = a.{c}" for c in key)
    return f"""{name}_n AS (SELECT {k}, count(DISTINCT row) AS nrows FROM {sim} GROUP BY ALL),
{name}_rec AS (
  WITH RECURSIVE st({k}, n, used, tot) AS (
    SELECT {k}, 0, CAST(0 AS BIGINT), CAST(0.0 AS DOUBLE) FROM {name}_n
    UNION ALL
    SELECT {ka}, a.n + 1, a.used | (CAST(1 AS BIGINT) << s.col), a.tot + s.score
    FROM st a JOIN {sim} s ON {on} AND s.row = a.n
    WHERE (a.used & (CAST(1 AS BIGINT) << s.col)) = 0)
  SELECT * FROM st),
{name} AS (SELECT {", ".join(f"r.{c}" for c in key)}, max(r.tot) AS total, any_value(q.nrows) AS pairs
           FROM {name}_rec r JOIN {name}_n q ON {" AND ".join(f"r.{c} = q.{c}" for c in key)}
           WHERE r.n = q.nrows GROUP BY ALL)"""
