"""Whole sweeps over algorithms and numbers of topics that can be resumed.

The unit of work is an (algorithm, k): its models (reference and runs) advance
in the same jobs. A unit's rankings and partitions are written to folders of
their own, then its line of the manifest; a unit whose line says ``done`` for
the same parameters is left alone, so a sweep that was killed goes on with what
is missing. A unit that fails is a line with its error, and the others go on.
Algorithms are independent: each has a thread and a scheduler pool of its name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources import store
from . import kmeans as km
from . import lda as ld
from . import nmf as nm
from . import sampling as sm
from .rankings import rank_terms
from .vectorize import Corpus

KEYS = sm.MODEL_KEY
MANIFEST = "algo string, k int, parameters string, state string, n_models long, error string"


@dataclass(frozen=True)
class Sweep:
    """Numbers of topics, runs beside the reference model and iterations of an algorithm."""
    kmin: int
    kmax: int
    runs: int
    iterations: int
    ratio: float = 0.8
    seed: int = 1000
    top: int = 100


def _nmf(corpus: Corpus, members: DataFrame, k: int, sweep: Sweep) -> tuple[DataFrame, DataFrame]:
    W, H, _ = nm.fit_rows(_rows(corpus, sweep), members, corpus.vocab, KEYS, sweep.iterations, sweep.seed)
    return nm.factor_weights(H, KEYS), nm.argmax_partition(W, KEYS)


def _lda(corpus: Corpus, members: DataFrame, k: int, sweep: Sweep) -> tuple[DataFrame, DataFrame]:
    weights, partition, _ = ld.fit(store.lda_counts(_rows(corpus, sweep)), members, corpus.vocab, KEYS, sweep.iterations, sweep.seed)
    return weights, partition


def _skm(corpus: Corpus, members: DataFrame, k: int, sweep: Sweep) -> tuple[DataFrame, DataFrame]:
    protos = cut_lineage(sm.prototype_sample(members, KEYS, k, seed=sweep.seed))  # models x topics rows, read several times
    rows = _rows(corpus, sweep)
    centres, partition, _ = km.kmeans(rows, members, km.prototype_centres(rows, protos, KEYS), KEYS, sweep.iterations,
                                      topics=protos, terms=corpus.vocab.count())
    return centres, partition.select(*KEYS, "doc_id", "topic")


def _rows(corpus: Corpus, sweep: Sweep) -> DataFrame:
    """The corpus's rows with the runs of the sweep, whose samples all algorithms and numbers of topics share."""
    return corpus.sampled(sweep.runs, sweep.ratio, sweep.seed)


FITTERS: dict[str, Callable] = {"nmf": _nmf, "lda": _lda, "skm": _skm}


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/*/*")
    except AnalysisException:  # no line yet
        return spark.createDataFrame([], MANIFEST)


def _unit(corpus: Corpus, folder: str, algo: str, k: int, sweep: Sweep, fit: Callable) -> tuple[str, int, str | None]:
    try:
        members = sm.run_row_members(_rows(corpus, sweep), algo, k, k)
        weights, partition = fit(corpus, members, k, sweep)
        ranked = rank_terms(weights, corpus.vocab, KEYS, top=sweep.top)
        ranked.write.mode("overwrite").parquet(f"{folder}/rankings/{algo}/{k}")
        partition.write.mode("overwrite").parquet(f"{folder}/partitions/{algo}/{k}")
        return "done", sweep.runs + 1, None
    except Exception as error:  # noqa: BLE001  the manifest has it; the other units go on
        return "failed", 0, f"{type(error).__name__}: {error}"[:500]


def run_models(corpus: Corpus, folder: str, sweeps: dict[str, Sweep], fitters: dict[str, Callable] | None = None) -> DataFrame:
    """Fit and write every model of the sweeps; the manifest (a line for each algorithm and k of ``sweeps``).

    ``folder``: shared by driver and executors, the same one to go on with a sweep. ``load`` reads the models.
    """
    spark = corpus.vocab.sparkSession
    fitters = fitters or FITTERS
    have = {(r["algo"], r["k"], r["parameters"]) for r in _lines(spark, folder).where("state = 'done'").collect()}

    def algorithm(algo: str) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", algo)
        sweep = sweeps[algo]
        for k in range(sweep.kmin, sweep.kmax + 1):
            # What a unit's models depend on: how many numbers of topics the sweep has doesn't matter.
            chosen = {n: v for n, v in asdict(sweep).items() if n not in ("kmin", "kmax")}
            mark = hashlib.md5(repr(sorted(chosen.items())).encode()).hexdigest()
            if (algo, k, mark) not in have:
                line = (algo, k, mark, *_unit(corpus, folder, algo, k, sweep, fitters[algo]))
                spark.createDataFrame([line], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/{algo}/{k}")

    with ThreadPoolExecutor(max(1, len(sweeps))) as pool:
        for job in [pool.submit(inheritable_thread_target(spark)(algorithm), algo) for algo in sweeps]:
            job.result()
    wanted = spark.createDataFrame([(a, k) for a, s in sweeps.items() for k in range(s.kmin, s.kmax + 1)], "algo string, k int")
    return _lines(spark, folder).join(F.broadcast(wanted), ["algo", "k"], "left_semi")


def load(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The ``rankings`` or ``partitions`` of all finished units of a folder."""
    done = _lines(spark, folder).where("state = 'done'").select("algo", "k").collect()  # a line for each algorithm and k
    if not done:
        raise ValueError("no model is finished")
    return spark.read.parquet(*[f"{folder}/{kind}/{r['algo']}/{r['k']}" for r in done])
