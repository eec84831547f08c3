"""Model grid and deterministic document samples.

Random choices are md5 orders of ``seed:run:id`` strings, so Spark, DuckDB
and a re-run after a lost executor all pick the same documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MODEL_KEY = ["algo", "kind", "k", "run"]


def model_grid(spark: SparkSession, algo: str, kmin: int, kmax: int, runs: int,
               seed: int = 1000, reference: bool = True) -> DataFrame:
    """One row per model: reference (run 0, all documents) and runs 1..r."""
    ks = F.explode(F.sequence(F.lit(kmin), F.lit(kmax))).alias("k")
    run_rows = spark.range(1).select(ks).select(
        F.lit(algo).alias("algo"), F.lit("run").alias("kind"), F.col("k").cast("int").alias("k"),
        F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"),
    )
    grid = run_rows
    if reference:
        ref = spark.range(1).select(ks).select(
            F.lit(algo).alias("algo"), F.lit("reference").alias("kind"),
            F.col("k").cast("int").alias("k"), F.lit(0).alias("run"),
        )
        grid = ref.unionByName(run_rows)
    return grid.withColumn("seed", F.lit(seed).cast("int"))


def sample_key(seed: int, run, doc_id) -> "F.Column":
    return F.md5(F.concat_ws(":", F.lit(str(seed)), run.cast("string"), doc_id.cast("string")))


def _sample_edges(doc_ids: DataFrame, runs: int, ratio: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their hash and bin for each run, and the bin in which the run's sample ends with what it needs of it."""
    n_sample = F.floor(F.lit(float(ratio)) * doc_ids.agg(F.count(F.lit(1))).scalar()).cast("bigint")
    hashed = doc_ids.select(
        "doc_id", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run")
    ).withColumn("_h", sample_key(seed, F.col("run"), F.col("doc_id"))).withColumn("_b", F.substring("_h", 1, 4))
    bins = hashed.groupBy("run", "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("run").orderBy("_b"))
    edges = (bins.withColumn("_upto", upto).withColumn("_need", n_sample - (F.col("_upto") - F.col("_n")))
             .where((F.col("_upto") > n_sample) & (F.col("_need") >= 0))
             .select("run", F.col("_b").alias("_edge"), "_need"))
    return hashed, edges


def sample_runs(doc_ids: DataFrame, runs: int, ratio: float = 0.8, seed: int = 1000,
                complement: bool = False) -> DataFrame:
    """(run, doc_id) with exactly int(ratio * n) documents per run.

    Each run takes the first documents in md5(seed:run:doc_id) order. Counts
    per (run, first four hex digits), at most 65,536 rows a run, tell in which
    of those bins a run's sample ends: bins before it belong to the sample
    whole, by a narrow filter, and only the documents of that one bin are
    ordered. ``complement`` returns the documents each run leaves out instead.
    """
    hashed, edges = _sample_edges(doc_ids, runs, ratio, seed)
    # one row per run at most; a run without an edge takes every document
    placed = hashed.join(F.broadcast(edges), "run", "left")
    at_edge = placed.where(F.col("_b") == F.col("_edge")).withColumn(
        "_pos", F.row_number().over(Window.partitionBy("run").orderBy("_h")))
    if complement:
        whole, part = placed.where(F.col("_b") > F.col("_edge")), at_edge.where(F.col("_pos") > F.col("_need"))
    else:
        whole = placed.where(F.col("_edge").isNull() | (F.col("_b") < F.col("_edge")))
        part = at_edge.where(F.col("_pos") <= F.col("_need"))
    return whole.select("run", "doc_id").unionByName(part.select("run", "doc_id"))


def run_rows(rows: DataFrame, doc_ids: DataFrame, runs: int, ratio: float = 0.8, seed: int = 1000) -> DataFrame:
    """B5 inside the row: document rows with ``runs``, the numbers of the runs whose samples hold the document (0: the
    reference, all of them). The samples are those of ``sample_runs``.

    A sample is what comes up to its last document in md5 order. That hash, one a run, is found once; which runs a row is in
    follows from the row alone, so no table of members meets the documents.
    """
    last = {}
    if runs > 0:
        hashed, edges = _sample_edges(doc_ids, runs, ratio, seed)
        at_edge = hashed.join(F.broadcast(edges), "run").where(F.col("_b") == F.col("_edge")).withColumn(
            "_pos", F.row_number().over(Window.partitionBy("run").orderBy("_h"))).where(F.col("_pos") <= F.col("_need"))
        ends = at_edge.groupBy("run").agg(F.max("_h").alias("_last"))
        # Hashes of a bin come behind its digits: those alone end a sample that needs none of the bin.
        last = {r["run"]: r["_end"] for r in edges.join(ends, "run", "left").select(
            "run", F.coalesce("_last", "_edge").alias("_end")).collect()}
    own = [F.when(sample_key(seed, F.lit(r), F.col("doc_id")) <= F.lit(last[r]), F.lit(r)) if r in last else F.lit(r)
           for r in range(1, runs + 1)]
    return rows.withColumn("runs", F.array_compact(F.array(F.lit(0), *own)))


def run_row_members(rows: DataFrame, algo: str, kmin: int, kmax: int) -> DataFrame:
    """The members of ``model_members`` from rows with ``runs``."""
    return rows.select("doc_id", F.explode("runs").alias("run")).select(
        F.lit(algo).alias("algo"), F.when(F.col("run") == 0, F.lit("reference")).otherwise(F.lit("run")).alias("kind"),
        F.explode(F.sequence(F.lit(kmin), F.lit(kmax))).alias("k"), F.col("run").cast("int").alias("run"), "doc_id")


def run_members(doc_ids: DataFrame, runs: int, ratio: float = 0.8, seed: int = 1000,
                reference: bool = True) -> DataFrame:
    """(run, doc_id): run 0 holds every document (the reference model), runs
    1..r their samples. A sample depends on (seed, run) only, so it is the
    same for every k."""
    parts = []
    if reference:
        parts.append(doc_ids.select(F.lit(0).alias("run"), "doc_id"))
    if runs > 0:
        parts.append(sample_runs(doc_ids, runs, ratio, seed))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def model_members(doc_ids: DataFrame, algo: str, kmin: int, kmax: int, runs: int,
                  ratio: float = 0.8, seed: int = 1000, reference: bool = True) -> DataFrame:
    """Documents of every model of the grid (model key + doc_id): each
    member row of a run is repeated for each k by a narrow explode."""
    members = run_members(doc_ids, runs, ratio, seed, reference)
    return members.select(
        F.lit(algo).alias("algo"),
        F.when(F.col("run") == 0, F.lit("reference")).otherwise(F.lit("run")).alias("kind"),
        F.explode(F.sequence(F.lit(kmin), F.lit(kmax))).alias("k"),
        F.col("run").cast("int").alias("run"), "doc_id",
    )


def prototype_sample(members: DataFrame, key_cols: list[str], k_max: int, k_col: str = "k",
                     seed: int = 1000) -> DataFrame:
    """K distinct documents per model, first in md5(seed:proto:model:doc) order.

    ``row_number <= k`` lets Spark keep a per-task top-k before the shuffle
    (window group limit), so no model's members are gathered in one task.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("proto"),
                            *[F.col(c).cast("string") for c in key_cols], F.col("doc_id").cast("string")))
    w = Window.partitionBy(*key_cols).orderBy(key)
    return (members.withColumn("_rn", F.row_number().over(w))
            .where((F.col("_rn") <= F.lit(k_max)) & (F.col("_rn") <= F.col(k_col)))
            .select(*key_cols, "doc_id", (F.col("_rn") - 1).cast("int").alias("topic")))
