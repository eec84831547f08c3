"""Spectral embedding of documents and spectral spherical k-means.

The similarity matrix S = X X' with a zero diagonal is never built. With the
degrees d = X (X'1) - |x|^2 and D = diag(d), the operator

    v -> D^-1/2 (X (X' D^-1/2 v) - |x|^2 D^-1/2 v)

is one terms x block matrix of sums, which lies in blocks of terms (``blocks``),
between two products with the packed documents. Block subspace iteration on it
(shifted by one, so that the largest eigenvalues lead) gives the embedding; only
block x block matrices reach the driver. The documents lie on a shelf (``packed``),
written once. A step is one narrow pass over it: a unit's documents get their new
vectors from the sums and their old ones, and what the vectors add to the next sums
is added up on the spot. Vectors lie beside the shelf in a file for each unit; a step
removes those that it read, so two versions stand at most.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import blocks as bl
from . import kmeans as km
from . import packed as pk
from .centroids import build_centroids
from .packed import Rows, Shelf, pack, row_lists

STEPS = 25


def _squares(rows: Rows) -> np.ndarray:
    return np.bincount(rows.doc, rows.weights ** 2, len(rows.ends))


OWN = 2  # numbers of a document before its vector: its root (of D^-1) and |x|^2


def _scaled(v: np.ndarray) -> np.ndarray:
    """D^-1/2 V."""
    return v[:, :1] * v[:, OWN:]


def _grams(v: np.ndarray) -> np.ndarray:
    """V'V and, with D^-1/2 V times each document's length for V, the part that the diagonal takes."""
    own, diagonal = v[:, OWN:], np.sqrt(v[:, 1:2]) * _scaled(v)
    return np.concatenate([(g.T @ g).ravel() for g in (own, diagonal)])


def _place(folder: str, unit: int) -> str:
    return f"{folder}/part-{unit:05d}.npy"


def _vectors(folder: str, unit: int) -> np.ndarray:
    store, path = bl._place(_place(folder, unit))
    with store.open_input_file(path) as src:
        return np.load(io.BytesIO(src.read()), allow_pickle=False)


def _with(batch: pa.RecordBatch, v: np.ndarray) -> pa.RecordBatch:
    return batch.append_column("v", _lists(v)).replace_schema_metadata(batch.schema.metadata)


def _lists(v: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))


def _step(shelf: Shelf, read: bl.TermSide, side: bl.TermSide, of: Callable, before: str | None, after: str) -> tuple[bl.TermSide, np.ndarray]:
    """(the next version of ``side``: X' D^-1/2 V; the Gram matrices) of the documents' new numbers (``OWN`` and V).

    ``of(rows, v, columns of read)`` gives them from those in the folder ``before``; they are written to ``after``.
    """
    spark = shelf.sparkSession
    folder, limit, width = pk.scratch_path(spark, "term-sums"), pk.GROUP_BYTES, side.widths[0]

    def run(units):
        partials, small = bl.Partials(side, side.widths, folder, limit), {}
        for unit, batch in units:
            parts = []
            for rows in pk.slices(_with(batch, _vectors(before, unit)) if before else batch):
                whole, found = rows.compact(read.terms)
                parts.append(of(whole, whole.v, read.take(0, found)))
                partials.add(0, found, whole.transposed(_scaled(parts[-1]), len(found)))
                own = _grams(parts[-1])
                small[0] = small[0] + own if small else own
            bl._save(_place(after, unit), np.concatenate(parts))
        yield bl.told((partials.leave(), small))

    small, sums = bl.collected(folder, pk.tasks(shelf, run, bl.TOLD, units=True).collect())
    side, _ = bl.renew(spark, side, sums, lambda m, old, num, extra, low: (num, None))
    return side, small.get(0, np.zeros(2 * width * width)).reshape(2, width, width)  # no documents: zeros


def _between_terms(side: bl.TermSide, spark) -> np.ndarray:
    """Y Y' of a term side Y."""
    _, parts = bl.renew(spark, side, None, lambda m, y, num, extra, low: (y, (y @ y.T).ravel()), write=False)
    return np.sum(parts[0], axis=0).reshape(side.widths[0], -1)


def spectral_embedding(doc_terms: DataFrame, doc_ids: DataFrame | None, terms: int, k: int, seed: int = 1000, steps: int = STEPS) -> DataFrame:
    """(doc_id, embedding of k numbers): the leading eigenvectors but the first, over the square root of the degree.

    Documents without neighbours (degree 0) are at the origin. The term side (terms x (k + 5) numbers) lies in blocks, at any
    size of the vocabulary; block x block matrices reach the driver. ``doc_ids``: the documents, or None for those of
    ``doc_terms``, whose rows with lists are then read as they stand.
    """
    width = k + 1 + 4
    spark = doc_terms.sparkSession
    if doc_ids is None:
        packed = row_lists(doc_terms).select("doc_id", F.array(F.lit(0)).alias("models"), "terms", "weights")
    else:
        packed, _ = pack(doc_terms, doc_ids.select("doc_id", F.lit(k).alias("k")), ["k"])
    shelf = pk.shelve(packed)
    column = bl.create(spark, terms, {0: 1}, lambda m, low, high: np.zeros((1, high - low)), "spectral-terms")
    _, sums = bl.totals(shelf, column, [0], lambda rows, m, c, extra: (rows.transposed(np.ones((len(rows.ends), 1)), c.shape[1]), np.zeros(1)))
    column, _ = bl.renew(spark, column, sums, lambda m, old, num, extra, low: (num, None))

    def start(rows, v, sums):
        """The degree's inverse root, |x|^2 and a random block; ids seed the block, so that it is the same on every run."""
        squares = _squares(rows)
        d = np.maximum(rows.times(sums)[:, 0] - squares, 0.0)
        noise = np.stack([np.random.default_rng([seed, i]).standard_normal(width) for i in _codes(rows.ids)])
        return np.concatenate([np.where(d > 1e-12, 1 / np.sqrt(np.maximum(d, 1e-12)), 0.0)[:, None], squares[:, None], noise], axis=1)

    path = scratch_path(spark, "spectral")
    side = bl.create(spark, terms, {0: width}, lambda m, low, high: np.zeros((width, high - low)), "spectral-terms")
    side, (gram, diagonal) = _step(shelf, column, side, start, None, path)
    bl.drop(f"{column.folder}/{column.version}")
    for nth in range(steps):
        # A pass gives the sums of the vectors as they are and their Gram matrix; the turn that makes them orthonormal
        # follows from it and is applied to vectors and sums in the next pass.
        def step(rows, v, sums, turn=_orthonormal(gram) if nth else np.eye(width)):
            root, square, block = v[:, :1], v[:, 1:2], v[:, OWN:] @ turn
            return np.concatenate([v[:, :OWN], block + root * (rows.times(sums) @ turn - square * (root * block))], axis=1)

        before, path = path, scratch_path(spark, "spectral")
        side, (gram, diagonal) = _step(shelf, side, side, step, before, path)
        bl.drop(before)
    # Rayleigh-Ritz: the eigenvectors of the operator within the block
    turn = _orthonormal(gram) if steps else np.eye(width)
    values, vectors = np.linalg.eigh(turn.T @ (_between_terms(side, spark) - diagonal) @ turn)
    bl.drop(f"{side.folder}/{side.version}")
    last = turn @ vectors[:, np.argsort(-values)][:, 1:k + 1]

    def embed(units):
        for unit, batch in units:
            v = _vectors(path, unit)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(_scaled(v) @ last)], names=["doc_id", "embedding"])

    out = scratch_path(spark, "spectral-embedding")
    schema = f"doc_id {packed.schema['doc_id'].dataType.simpleString()}, embedding array<double>"
    pk.mapped(shelf, embed, schema, units=True).write.parquet(out)
    bl.drop(path)
    shelf.drop()
    return spark.read.schema(schema).parquet(out)


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """The turn that makes a block with this Gram matrix orthonormal, the greatest directions first."""
    values, vectors = np.linalg.eigh(gram)
    return (vectors / np.sqrt(np.maximum(values, 1e-300)))[:, ::-1]


def _codes(ids: pa.Array) -> list[int]:
    import zlib
    return [zlib.crc32(str(i).encode()) for i in ids.to_pylist()]


def spectral_kmeans(doc_terms: DataFrame, doc_ids: DataFrame | None, terms: int, k: int, seed: int = 1000, max_iter: int = 100,
                    delta: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """(centroids, partition): cosine k-means on the embedding from k md5-chosen documents, centroids as means in the
    original term space. A cluster without documents has no rows."""
    embedding = spectral_embedding(doc_terms, doc_ids, terms, k, seed)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("proto"), F.col("doc_id").cast("string")))
    rows = embedding.select("doc_id", F.array(*[F.lit(j) for j in range(k)]).alias("terms"), F.col("embedding").alias("weights"))
    members = embedding.select(F.lit(k).alias("k"), "doc_id")
    chosen = [r["doc_id"] for r in embedding.orderBy(key).limit(k).collect()]
    kind = embedding.schema["doc_id"].dataType.simpleString()
    protos = doc_terms.sparkSession.createDataFrame([(k, d, j) for j, d in enumerate(chosen)], f"k int, doc_id {kind}, topic int")
    init = km.prototype_centres(rows, protos, ["k"])
    _, partition, _ = km.kmeans(rows, members, init, ["k"], max_iter=max_iter, delta=delta, topics=protos, terms=k)
    return build_centroids(doc_terms, partition, ["k"]), partition
