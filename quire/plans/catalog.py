"""Registered queries: one per operator of the inventory, each reading the
driver tables of a scale-factor folder, plus its DuckDB oracle SQL.

Conventions shared with the oracle: integers are BIGINT, doubles are
rounded to 6 places, every computed column is aliased.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vectorize as vz
from ..plans import oracle_sql as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)  # + 0.0 turns -0.0 into 0.0


def i64(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("bigint")


MATRIX_CFG = vz.CorpusConfig(stopwords=O.QUERY_STOPWORDS, min_df=O.MIN_DF, tfidf=True, norm=True)
COUNT_CFG = vz.CorpusConfig(stopwords=O.QUERY_STOPWORDS, min_df=O.MIN_DF, tfidf=False, norm=False)


def corpus(spark: SparkSession, sf_dir: str, label_col: str = "lang",
           cfg: vz.CorpusConfig = MATRIX_CFG) -> vz.Corpus:
    docs = vz.prepare_documents(table(spark, sf_dir, "documents"), label_col=label_col,
                                min_length=cfg.min_doc_length)
    return vz.build_corpus(docs, cfg)


# Import the query modules so that they register themselves.
from . import queries_text  # noqa: E402,F401
from . import queries_rank  # noqa: E402,F401
from . import queries_valid  # noqa: E402,F401
from . import queries_models  # noqa: E402,F401
from . import queries_io  # noqa: E402,F401
from . import queries_lda  # noqa: E402,F401
from . import queries_reference  # noqa: E402,F401
from . import queries_sweep  # noqa: E402,F401
