"""Passes over document rows packed one to a row, for models whose term side is small.

A packed row holds a document's term indexes, weights and the models it is a
member of. The corpus is packed and written once; every pass over it is
narrow, whatever the number of models.

The term side of the models (``topics x terms`` numbers each) lies in blocks
(``blocks``); models are taken in groups whose sums are at most ``GROUP_BYTES``
together, or one by one.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

GROUP_BYTES = 64 << 20
SLICE_NNZ = 1 << 18  # non-zeros handled at a time inside a batch
UNIT_NNZ = 1 << 19  # non-zeros of a file of a shelf, or one Arrow batch more
FOUND = b"found"  # in a unit's schema: its terms, ascending; the rows number them from 0


def groups(sizes: list[int], terms: int) -> Iterator[list[int]]:
    """Indexes of models in groups of bounded size; ``sizes``: topics of each."""
    out, held = [], 0
    for i, k in enumerate(sizes):
        if out and (held + k) * terms * 8 > GROUP_BYTES:
            yield out
            out, held = [], 0
        out.append(i)
        held += k
    if out:
        yield out


@dataclass
class Rows:
    """Some documents: where each one's non-zeros end, their terms and weights."""
    ids: pa.Array
    ends: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    models: tuple[np.ndarray, np.ndarray]  # (document, model) of each membership
    found: np.ndarray | None = None  # the terms of compact rows
    v: np.ndarray | None = None  # numbers of each document, where the table has some

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def of_model(self, model: int) -> "Rows":
        has = np.zeros(len(self.ends), bool)
        has[self.models[0][self.models[1] == model]] = True
        if has.all():
            return self
        n = np.diff(self.ends, prepend=0)
        keep = np.repeat(has, n)
        return Rows(self.ids.filter(pa.array(has)), np.cumsum(n[has]), self.terms[keep], self.weights[keep],
                    (np.zeros(0, int), np.zeros(0, int)), self.found, None if self.v is None else self.v[has])

    def compact(self, terms: int) -> tuple["Rows", np.ndarray]:
        """The rows with terms numbered by those that occur, and these, ascending; those of a shelf are so already."""
        if self.found is not None:
            return self, self.found
        if terms > 1 << 22:
            found, at = np.unique(self.terms, return_inverse=True)
        else:
            seen = np.zeros(terms, bool)
            seen[self.terms] = True
            found = np.flatnonzero(seen)
            at = (np.cumsum(seen) - 1)[self.terms]
        return replace(self, terms=at, found=found), found

    def times(self, dense: np.ndarray) -> np.ndarray:
        """X D' for a dense (topics x terms) block D: documents x topics."""
        out = np.zeros((len(self.ends), len(dense)))
        held = np.flatnonzero(np.diff(self.ends, prepend=0))
        if len(held):
            starts = self.starts[held]
            for j, row in enumerate(dense):
                out[held, j] = np.add.reduceat(row.take(self.terms) * self.weights, starts)
        return out

    def transposed(self, left: np.ndarray, terms: int) -> np.ndarray:
        """L' X for documents x topics L: topics x terms."""
        n = np.diff(self.ends, prepend=0)
        return np.stack([np.bincount(self.terms, np.repeat(left[:, j], n) * self.weights, terms) for j in range(left.shape[1])])


def explode_rows(rows: DataFrame, kept: list[str], lists: dict[str, str]) -> DataFrame:
    """A row for each place of the lists (column -> name); a row without any gives none."""
    # For an inner explode the optimizer adds a filter on the lists and pushes it below them, whatever makes them.
    zipped = F.arrays_zip(*lists)
    return rows.select(*kept, F.explode_outer(zipped).alias("_p")).where("_p is not null").select(
        *kept, *[F.col("_p")[c].alias(name) for c, name in lists.items()])


def row_lists(rows: DataFrame) -> DataFrame:
    """(doc_id, terms, weights), a row a document: rows that are so already (as ``Corpus.rows``) as they are, else those of
    (doc_id, term_idx, weight)."""
    if "terms" in rows.columns:
        return rows.select("doc_id", "terms", "weights")
    each = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term_idx", "weight"))).alias("x"))
    return each.select("doc_id", F.transform("x", lambda v: v["term_idx"].cast("int")).alias("terms"),
                       F.transform("x", lambda v: v["weight"].cast("double")).alias("weights"))


def row_cells(rows: DataFrame) -> DataFrame:
    """(doc_id, term_idx, weight) of either form."""
    return explode_rows(rows, ["doc_id"], {"terms": "term_idx", "weights": "weight"}) if "terms" in rows.columns else rows.select(
        "doc_id", "term_idx", "weight")


def row_terms(rows: DataFrame) -> int:
    """One more than the greatest term index of either form."""
    last = F.max(F.array_max("terms")) if "terms" in rows.columns else F.max("term_idx")
    return int(rows.agg(F.coalesce(last, F.lit(-1)) + 1).first()[0])


def pack(doc_terms: DataFrame, members: DataFrame, key_cols: list[str]) -> tuple[DataFrame, list[tuple]]:
    """The packed rows of all members, written once, and the model keys by model number (the grid of a sweep).

    ``doc_terms``: (doc_id, term_idx, weight), or rows with lists (``row_lists``), whose pairs are not shuffled one by one.
    Rows with ``runs`` too (``sampling.run_rows``) are packed as they stand: each model of ``members``, whose key has a
    ``run``, holds the documents of its run, and nothing is joined or written.
    """
    spark = doc_terms.sparkSession
    keys = sorted((tuple(r) for r in members.select(*key_cols).distinct().collect()), key=str)
    if "runs" in doc_terms.columns:
        at = key_cols.index("run")
        models = [F.when(F.array_contains("runs", key[at]), F.lit(i)) for i, key in enumerate(keys)]
        used = F.array(*[F.lit(r) for r in sorted({key[at] for key in keys})]).cast("array<int>")
        return doc_terms.where(F.arrays_overlap("runs", used)).select(
            "doc_id", F.array_compact(F.array(*models)).cast("array<int>").alias("models"), "terms", "weights"), keys
    kinds = {f.name: f.dataType.simpleString() for f in members.schema.fields}
    numbered = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], ", ".join(
        f"{c} {kinds[c]}" for c in key_cols) + ", _model int") if keys else members.select(*key_cols).limit(0).withColumn("_model", F.lit(0))
    lists = members.join(F.broadcast(numbered), key_cols).groupBy("doc_id").agg(F.collect_set("_model").alias("models"))
    rows = lists.join(row_lists(doc_terms), "doc_id", "left")
    rows = rows.select("doc_id", "models", F.coalesce("terms", F.array().cast("array<int>")).alias("terms"),
                       F.coalesce("weights", F.array().cast("array<double>")).alias("weights"))
    path = scratch_path(spark, "packed")
    rows.write.parquet(path)
    return spark.read.parquet(path), keys


def slices(batch: pa.RecordBatch) -> Iterator[Rows]:
    """A batch in pieces of bounded non-zeros; a unit of a shelf, which is bounded, in one."""
    found = (batch.schema.metadata or {}).get(FOUND)
    if found is not None:
        found, limit = np.frombuffer(found, np.int32).astype(np.int64), max(1, batch.num_rows and len(batch.column("terms").flatten()))
    else:
        limit = SLICE_NNZ
    terms, weights, models = (batch.column(c) for c in ("terms", "weights", "models"))
    off = np.asarray(terms.offsets).astype(np.int64)
    flat_t, flat_w = np.asarray(terms.values), np.asarray(weights.values)
    m_off, m_flat = np.asarray(models.offsets), np.asarray(models.values)
    w_off = np.asarray(weights.offsets).astype(np.int64)
    a, n = 0, batch.num_rows
    v = np.asarray(batch.column("v").flatten()).reshape(n, -1) if n and "v" in batch.schema.names else None
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1))
        own = flat_t[off[a]:off[b]]
        yield Rows(batch.column("doc_id").slice(a, b - a), off[a + 1:b + 1] - off[a], own if found is None else own.astype(np.int64),
                   flat_w[w_off[a]:w_off[b]],
                   (np.repeat(np.arange(b - a), np.diff(m_off[a:b + 1])), m_flat[m_off[a]:m_off[b]]), found,
                   None if v is None else v[a:b])
        a = b


@dataclass(frozen=True)
class Shelf:
    """Packed documents as mapped files (units) in the shared folder, for passes that are many: a pass maps them and neither
    decodes them nor takes them through the JVM, and terms are numbered within their unit. A unit holds the same documents in the same order in every pass."""
    sparkSession: SparkSession
    folder: str
    units: list[str]

    def __reduce__(self):  # tasks need no session
        return Shelf, (None, self.folder, self.units)

    def read(self, nth: int) -> pa.RecordBatch:
        from .blocks import _place

        store, path = _place(f"{self.folder}/{self.units[nth]}")
        src = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        with pa.ipc.open_file(src) as file:
            return file.get_batch(0)

    def drop(self) -> None:
        from .blocks import drop

        drop(self.folder)


def shelve(packed: DataFrame) -> Shelf:
    """The packed rows written once as a shelf, by a narrow pass."""
    from .blocks import TOLD, _place, told

    spark = packed.sparkSession
    folder, limit = scratch_path(spark, "shelf"), UNIT_NNZ

    def write(batches):
        units, held, n = [], [], 0

        def leave():
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            lists = batch.column("terms")
            flat = np.asarray(lists.values)[lists.offsets[0].as_py():lists.offsets[-1].as_py()]
            rows, found = Rows(None, None, flat, None, None).compact(int(flat.max(initial=-1)) + 1)
            offsets = pa.array(np.asarray(lists.offsets) - lists.offsets[0].as_py(), pa.int32())
            batch = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("models"), pa.ListArray.from_arrays(offsets, pa.array(rows.terms, pa.int32())), batch.column("weights")],
                names=["doc_id", "models", "terms", "weights"]).replace_schema_metadata({FOUND: found.astype(np.int32).tobytes()})
            store, path = _place(f"{folder}/{uuid.uuid4().hex}.arrow")
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(path) as out, pa.ipc.new_file(out, batch.schema) as file:
                file.write_batch(batch)
            units.append(path.rsplit("/", 1)[1])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += len(batch.column("terms").flatten())
                if n >= limit:
                    leave()
                    held, n = [], 0
        if held:
            leave()
        yield told(units)

    # Files of failed attempts are named by no task that ended well.
    made = packed.select("doc_id", "models", "terms", "weights").mapInArrow(write, TOLD).collect()
    return Shelf(spark, folder, [u for r in made for u in pickle.loads(r["told"])])


def mapped(packed: DataFrame | Shelf, run: Callable, schema: str, units: bool = False) -> DataFrame:
    """``run`` over the batches of packed rows; with ``units`` over (number, batch) of a shelf."""
    if not isinstance(packed, Shelf):
        return packed.mapInArrow(run, schema)
    spark, n = packed.sparkSession, len(packed.units)

    def read(batches):
        numbers = (i for batch in batches for i in batch.column("id").to_pylist())
        yield from run(((i, packed.read(i)) if units else packed.read(i)) for i in numbers)

    return spark.range(0, n, 1, max(1, min(n, spark.sparkContext.defaultParallelism))).mapInArrow(read, schema)


def tasks(packed: DataFrame | Shelf, run: Callable, schema: str, units: bool = False) -> DataFrame:
    """``mapped`` by as many tasks as cores."""
    if isinstance(packed, Shelf):
        return mapped(packed, run, schema, units)
    return mapped(packed.coalesce(max(1, packed.sparkSession.sparkContext.defaultParallelism)), run, schema)
