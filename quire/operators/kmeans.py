"""Generalised k-means on sparse document-term rows.

Every model of a sweep (key columns) advances in the same Spark jobs. An
iteration passes once over the documents, packed one to a row: each finds its
nearest centre in mapped blocks of terms (``blocks``), and what it adds to that
centre is summed by block; a second, small pass renews the blocks. The driver
reads the mean distance of each model.

The stop rule and its defaults are fixed values: stop when (1 - delta) * prev <= avg <= prev
or at the last iteration; an empty cluster keeps its previous centre.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import blocks as bl
from .packed import groups, pack, row_cells, row_lists, row_terms


# ---------------------------------------------------------------------------
# Distances between dense vectors (array columns), a small metric set.
# ---------------------------------------------------------------------------
def _zip(a: Column, b: Column, fn) -> Column:
    return F.zip_with(a, b, fn)


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def distance(a: Column, b: Column, metric: str = "cosine", p: float = 2.0) -> Column:
    """Distance between two numeric arrays: cosine, euclidean, sqeuclidean,
    cityblock, chebyshev or minkowski (power p). Cosine of a zero vector = 1."""
    a = a.cast("array<double>")
    b = b.cast("array<double>")
    if metric == "cosine":
        dot = _sum(_zip(a, b, lambda x, y: x * y))
        na = F.sqrt(_sum(F.transform(a, lambda x: x * x)))
        nb = F.sqrt(_sum(F.transform(b, lambda x: x * x)))
        return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(1 - dot / (na * nb))
    if metric == "sqeuclidean":
        return _sum(_zip(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "euclidean":
        return F.sqrt(_sum(_zip(a, b, lambda x, y: (x - y) * (x - y))))
    if metric == "cityblock":
        return _sum(_zip(a, b, lambda x, y: F.abs(x - y)))
    if metric == "chebyshev":
        return F.aggregate(_zip(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: F.greatest(acc, x))
    if metric == "minkowski":
        return F.pow(_sum(_zip(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1.0 / p))
    raise ValueError(f"unknown metric {metric}")


CENTRE_BLOCK = 256


def distances_to_centres(points: DataFrame, centres: DataFrame, vec: str = "embedding",
                         metrics=("cosine",)) -> DataFrame:
    """D12 for dense vectors: distance of every point to every centre.

    The centres are packed to rows of at most ``CENTRE_BLOCK``; every point
    names each block and meets it in an equi-join that the planner broadcasts
    by its real size, then computes the block's distances in place.
    Output: point columns + topic + one column per metric.
    """
    packed = centres.groupBy(F.floor(F.col("topic") / CENTRE_BLOCK).alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct("topic", F.col(vec).cast("array<double>").alias("c")))).alias("_cs"))
    last = centres.agg(F.floor(F.max("topic") / CENTRE_BLOCK)).scalar()
    named = points.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_block"))
    ex = named.join(packed, "_block").select(*points.columns, F.explode("_cs").alias("_c"))
    cols = [distance(F.col(vec), F.col("_c.c"), m).alias(m) for m in metrics]
    return ex.select(*[c for c in points.columns], F.col("_c.topic").alias("topic"), *cols)


def nearest(dist: DataFrame, key_cols: list[str], metric: str) -> DataFrame:
    """Nearest centre per point (lowest topic wins a tie, distances compared
    after rounding to 12 places)."""
    best = F.min(F.struct(F.round(metric, 12).alias("_r"), F.col("topic").alias("topic"), F.col(metric).alias("d")))
    return dist.groupBy(*key_cols).agg(best.alias("_b")).select(
        *key_cols, F.col("_b.topic").alias("topic"), F.col("_b.d").alias("distance"))


def dense_centres(points: DataFrame, assign: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """D11 (centre update, dense): topic, dim, value: the mean of the member vectors of each topic."""
    return (points.join(assign.select(key, "topic"), key).select("topic", F.posexplode(vec).alias("dim", "_v"))
            .groupBy("topic", "dim").agg(F.avg(F.col("_v").cast("double")).alias("value")))


# ---------------------------------------------------------------------------
# Sparse spherical k-means over document-term rows
# ---------------------------------------------------------------------------
def cosine_distances(rows, centres: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Documents x topics; 1 where either side is zero, infinite for topics that the model doesn't have (norm null)."""
    size = np.sqrt(np.bincount(rows.doc, rows.weights ** 2, len(rows.ends)))
    scale = size[:, None] * np.where(norms > 0, norms, 0.0)[None, :]
    out = np.where(scale > 0, 1 - rows.times(centres) / np.where(scale > 0, scale, 1.0), 1.0)
    return np.where(np.isnan(norms)[None, :], np.inf, out)


def _nearest(rows, centres: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(topic, distance) of each document; the lowest topic wins a tie, distances compared after rounding to 12 places."""
    d = cosine_distances(rows, centres, norms)
    topic = np.argmin(np.round(d, 12), axis=1)
    return topic, d[np.arange(len(d)), topic]


def _member_sums(rows, model, centres, extra):
    """What documents add to their nearest topics, the distances and sizes."""
    topic, d = _nearest(rows, centres, extra)
    k, of = len(centres), topic[rows.doc]
    num = np.stack([np.bincount(rows.terms, rows.weights * (of == j), centres.shape[1]) for j in range(k)])
    return num, np.concatenate([[d.sum(), len(d)], np.bincount(topic, minlength=k)])


def _next_centres(model, old, num, extra, low):
    """Member means; a topic without members keeps its centre, and a model that has stopped its centres."""
    if extra is not None:
        size = extra[2:][:, None]
        old = np.where(size > 0, num / np.maximum(size, 1), old)
    return old, (old ** 2).sum(1)


SPARSE_METRICS = ("cosine", "euclidean", "cityblock", "chebyshev", "minkowski")


def _powers(model, centres, num, power, low):
    """Sums over terms of |c|, c^2 and |c|^p of each centre."""
    size = np.abs(centres)
    return centres, np.concatenate([size.sum(1), (size ** 2).sum(1), (size ** power).sum(1)])


def _farthest_outside(rows, k: int, tops: list[tuple[np.ndarray, np.ndarray]], found: np.ndarray) -> np.ndarray:
    """The greatest |c| of each centre over the terms that a document doesn't hold. ``tops``: the centre's greatest values and
    their terms, falling, one more than any document has terms; ``found``: the terms of the columns."""
    out = np.zeros((len(rows.ends), k))
    held = np.sort(rows.doc.astype(np.int64) * (len(found) + 1) + rows.terms)
    for j, (values, terms) in enumerate(tops):
        column = np.searchsorted(found, terms)
        here = (column < len(found)) & (found[np.minimum(column, len(found) - 1)] == terms) if len(found) else np.zeros(len(terms), bool)
        live = np.arange(len(rows.ends))
        for value, at, known in zip(values, column, here):
            if not len(live):
                break
            key = live * (len(found) + 1) + at
            place = np.searchsorted(held, key)
            inside = known & (place < len(held)) & (held[np.minimum(place, len(held) - 1)] == key) if len(held) else np.zeros(len(live), bool)
            out[live[~inside], j] = value
            live = live[inside]
    return out


def sparse_distances(rows: DataFrame, members: DataFrame | None, centres: DataFrame, key_cols: list[str],
                     metrics: tuple[str, ...] = SPARSE_METRICS, p: float = 3.0, terms: int | None = None) -> DataFrame:
    """key_cols, doc_id, topic and the distance by each metric of every member document to every centre of its model.

    Neither side is made dense: a document's terms are merged with the same columns of the centre, and what the centre has
    elsewhere comes from its sums (its greatest values, for chebyshev), less the shared columns. ``p``: power of minkowski.
    Without ``members`` every document of ``rows`` is one of each model of the centres; rows with lists are then read as they
    stand. ``terms``: one more than the greatest term index, found by a pass if not given.
    """
    keys = list(key_cols)
    spark = rows.sparkSession
    path = scratch_path(spark, "centre-cells")
    centres.select(*keys, "topic", "term_idx", "weight").write.parquet(path)  # read several times; a centre is a mean over all documents
    centres = spark.read.parquet(path)
    if members is None:
        grid = sorted((tuple(r) for r in centres.select(*keys).distinct().collect()), key=str)
        packed = row_lists(rows).select("doc_id", F.lit(list(range(len(grid)))).cast("array<int>").alias("models"), "terms", "weights")
    else:
        packed, grid = pack(rows, members, keys)
    terms = max(row_terms(rows), row_terms(centres)) if terms is None else terms
    table = F.broadcast(spark.createDataFrame([(*g, i) for i, g in enumerate(grid)], ", ".join(f"{c} {t}" for c, t in _types(centres, keys)) + ", _model int"))
    cells = centres.join(table, keys).select(F.col("_model").alias("model"), "topic", "term_idx", F.col("weight").alias("value"))
    top = {r["model"]: r["n"] for r in cells.groupBy("model").agg((F.max("topic") + 1).alias("n")).collect()}
    sizes = [top.get(i, 1) for i in range(len(grid))]
    tops: dict[tuple, tuple] = {}
    if "chebyshev" in metrics:  # as many as the longest document has terms, and one
        most = packed.agg(F.coalesce(F.max(F.size("terms")), F.lit(0)) + 1).scalar()
        place = F.row_number().over(Window.partitionBy("model", "topic").orderBy(F.desc(F.abs("value")), "term_idx"))
        falling = cells.withColumn("_place", place).where(F.col("_place") <= most).groupBy("model", "topic").agg(
            F.sort_array(F.collect_list(F.struct(F.abs("value").alias("v"), F.col("term_idx").alias("t"))), False).alias("x"))
        tops = {(r["model"], r["topic"]): (np.array([x["v"] for x in r["x"]]), np.array([x["t"] for x in r["x"]], np.int64)) for r in falling.collect()}
    parts = []
    for group in groups(sizes, max(1, terms)):
        side = bl.from_rows(cells.where(F.col("model").isin(group)), max(1, terms), {i: sizes[i] for i in group}, "centres")
        _, sums = bl.renew(spark, side, None, _powers, {m: p for m in group}, write=False)
        extra = {m: (np.sum(sums[m], axis=0).reshape(3, sizes[m]),
                     [tops.get((m, j), (np.zeros(0), np.zeros(0, np.int64))) for j in range(sizes[m])]) for m in group}

        def of(own, m, c, facts):
            (one, two, power), best = facts
            k, cols = len(c), {}
            here, x = c[:, own.terms], own.weights
            gap = np.abs(x[None, :] - here)

            def merged(total, inside, outside):
                return np.stack([np.maximum(total[j] - np.bincount(own.doc, outside[j], len(own.ends)), 0) + np.bincount(own.doc, inside[j], len(own.ends))
                                 for j in range(k)], axis=1)

            for metric in metrics:
                if metric == "cosine":
                    cols[metric] = cosine_distances(own, c, np.sqrt(two))
                elif metric == "euclidean":
                    cols[metric] = np.sqrt(merged(two, gap ** 2, here ** 2))
                elif metric == "cityblock":
                    cols[metric] = merged(one, gap, np.abs(here))
                elif metric == "minkowski":
                    cols[metric] = merged(power, gap ** p, np.abs(here) ** p) ** (1 / p)
                else:
                    cols[metric] = _farthest_outside(own, k, best, own.found)
                    for j in range(k):
                        np.maximum.at(cols[metric][:, j], own.doc, gap[j])
            return np.stack([cols[m] for m in metrics], axis=2).reshape(len(own.ends), -1)

        parts.append(bl.per_document(packed, side, group, of, packed.schema["doc_id"].dataType.simpleString(), extra))
    n = len(metrics)
    every = reduce(DataFrame.unionByName, parts).join(table, F.col("_nth") == F.col("_model"))
    each = F.transform(F.sequence(F.lit(0), F.expr(f"cast(size(v) div {n} as int) - 1")), lambda j: F.struct(
        j.cast("int").alias("topic"), *[F.get("v", j * n + i).alias(m) for i, m in enumerate(metrics)]))
    known = cells.select(F.col("model").alias("_m"), F.col("topic").alias("_t")).distinct()
    return every.select(*keys, "_nth", "doc_id", F.explode(each).alias("_d")).select(*keys, "_nth", "doc_id", "_d.*").join(
        F.broadcast(known), (F.col("_nth") == F.col("_m")) & (F.col("topic") == F.col("_t")), "left_semi").drop("_nth")  # models x topics rows


def kmeans(rows: DataFrame, members: DataFrame, init_centres: DataFrame, key_cols: list[str],
           max_iter: int = 100, delta: float = 0.001, topics: DataFrame | None = None, terms: int | None = None):
    """D11 (cosine) for every model at once.

    ``topics`` (keys, topic) lists the topics of each model where a starting
    centre may be empty; by default they are those that have centre rows. One
    whose centre is all zeros is at distance 1 from every document.

    rows: doc_id, term_idx, weight, or rows with lists (``Corpus.rows``). members: key_cols + doc_id.
    ``terms``: one more than the greatest term index, found by a pass if not given.
    init_centres: key_cols + topic, term_idx, weight.
    Returns (centres, assignment: key_cols + doc_id, topic, distance,
    iterations: key_cols + iterations, avg_distance).

    An iteration is one narrow pass over documents packed one to a row, for all models that haven't stopped, and one over
    the blocks of the centres: the rows of the documents are never repeated by model or shuffled.
    """
    keys = list(key_cols)
    spark = rows.sparkSession
    packed, grid = pack(rows, members, keys)
    terms = row_terms(rows) if terms is None else terms
    number = {key: i for i, key in enumerate(grid)}
    named: dict[int, set] = {i: set() for i in number.values()}
    for r in (init_centres if topics is None else topics).select(*keys, "topic").distinct().collect():  # models x topics
        if tuple(r)[:-1] in number:
            named[number[tuple(r)[:-1]]].add(r["topic"])
    sizes = [max(named[i], default=0) + 1 for i in range(len(grid))]
    kinds = ", ".join(f"{c} {t}" for c, t in _types(members, keys))
    table = F.broadcast(spark.createDataFrame([(*g, i) for i, g in enumerate(grid)], kinds + ", _model int"))
    start = init_centres.join(table, keys).select(F.col("_model").alias("model"), "topic", "term_idx", F.col("weight").alias("value"))
    done: dict[int, tuple[int, float]] = {}
    centres, parts = [], []
    for group in groups(sizes, max(1, terms)):
        side = bl.from_rows(start.where(F.col("model").isin(group)), max(1, terms), {i: sizes[i] for i in group}, "centres")
        _, squares = bl.renew(spark, side, None, _next_centres, write=False)
        live, last = list(group), {}
        for it in range(1, max_iter + 1):
            norms = {m: _norms(squares[m], named[m]) for m in group}
            small, sums = bl.totals(packed, side, live, _member_sums, norms)
            for m in list(live):
                mean = float(small[m][0] / small[m][1])
                if ((1 - delta) * last.get(m, 0.0) <= mean <= last.get(m, 0.0)) or it == max_iter:
                    live.remove(m)
                    done[m] = (it, mean)
                last[m] = mean
            if not live:
                bl.drop(sums)
                break
            side, squares = bl.renew(spark, side, sums, _next_centres, {m: small[m] for m in live})
        norms = {m: _norms(squares[m], named[m]) for m in group}
        centres.append(bl.table(spark, side).where("value <> 0"))
        parts.append(bl.per_document(packed, side, group, lambda r, m, c, n: np.stack(_nearest(r, c, n), axis=1),
                                     members.schema["doc_id"].dataType.simpleString(), norms))
    out = reduce(DataFrame.unionByName, centres).join(table, F.col("_nth") == F.col("_model")).select(
        *keys, "topic", "term_idx", F.col("value").alias("weight"))
    assigned = reduce(DataFrame.unionByName, parts).join(table, F.col("_nth") == F.col("_model")).select(
        *keys, "doc_id", F.get("v", F.lit(0)).cast("int").alias("topic"), F.get("v", F.lit(1)).alias("distance"))
    iterations = spark.createDataFrame([(*grid[m], *v) for m, v in done.items()], kinds + ", iterations int, avg_distance double")
    return out, assigned, iterations


def _norms(squares: list[np.ndarray], topics: set) -> np.ndarray:
    """The centres' norms; null for topics that the model doesn't have."""
    out = np.sqrt(np.sum(squares, axis=0))
    out[[j for j in range(len(out)) if j not in topics]] = np.nan
    return out


def _types(df: DataFrame, cols: list[str]):
    f = {x.name: x.dataType.simpleString() for x in df.schema.fields}
    return [(c, f[c]) for c in cols]


def prototype_centres(rows: DataFrame, prototypes: DataFrame, key_cols: list[str]) -> DataFrame:
    """B6 -> initial centres: the rows of the chosen documents."""
    chosen = F.broadcast(prototypes.select("doc_id").distinct())  # models x topics rows
    return prototypes.join(row_cells(rows.join(chosen, "doc_id", "left_semi")), "doc_id").select(
        *key_cols, "topic", "term_idx", "weight")
