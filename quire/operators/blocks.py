"""The term side of models as matrices in blocks of terms, and the passes that read and renew them.

A model's term side (topics x terms: NMF factors, topic-term counts, centres,
singular vectors) never stands whole in a task or on the driver. It lies in the
shared folder in files of ``BLOCK_BYTES`` for a range of terms each; tasks map a
file and take the columns of the terms that their documents hold. A round is

    totals   a narrow pass over packed documents; what a slice of documents adds
             to the terms it holds goes to blocks, which are written to one file
             when they exceed ``GROUP_BYTES`` or the task ends
    renew    every block of the next version from its old values and its sums, which
             are added up from the places that the tasks of the pass named

No round shuffles, so nothing of it stays on the executors' disks when its files are
removed. Sums that don't depend on terms (``small``: Gram matrices, objectives) come to
the driver, models x topics^2 numbers of them from a task. A version's file has a name
that depends on version and block only and is moved into place, so a task that runs
again puts the same file there; a file of sums counts only if its task ended well. The
limits set how much is handled at a time, never what is computed.
"""

from __future__ import annotations

import io
import pickle
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import packed as pk

BLOCK_BYTES = 1 << 20
LOADED = 64  # files that a task's process keeps mapped


def _place(uri: str):
    parts = urlsplit(uri)
    return (fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


def _save(uri: str, array: np.ndarray) -> None:
    store, path = _place(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
    store.move(part, path)


_loaded: OrderedDict[str, np.ndarray] = OrderedDict()


def _load(uri: str) -> np.ndarray:
    if uri in _loaded:
        _loaded.move_to_end(uri)
        return _loaded[uri]
    # A mapped file takes disk after it is removed: older versions of the same folder go first.
    version, _, _ = uri.rpartition("/")
    for old in [u for u in _loaded if u.rsplit("/", 2)[0] == version.rpartition("/")[0] and not u.startswith(f"{version}/")]:
        del _loaded[old]
    while len(_loaded) >= LOADED:
        _loaded.popitem(last=False)
    store, path = _place(uri)
    if isinstance(store, fs.LocalFileSystem):
        _loaded[uri] = np.load(path, mmap_mode="r", allow_pickle=False)
    else:
        with store.open_input_file(path) as src:
            _loaded[uri] = np.load(io.BytesIO(src.read()), allow_pickle=False)
    return _loaded[uri]


def load_part(uri: str, first: int, last: int) -> np.ndarray:
    """Some numbers of a flat file, which isn't kept."""
    store, path = _place(uri)
    with store.open_input_file(path) as src:
        return np.frombuffer(src.read_at(8 * (last - first), 8 * first), np.float64)


def _save_flat(uri: str, arrays: Iterable[np.ndarray]) -> None:
    store, path = _place(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as out:
        for array in arrays:
            out.write(np.ascontiguousarray(array, np.float64).data)


@dataclass(frozen=True)
class Sums:
    """What the tasks of a pass left for blocks: the file, the model and the first and last number, by block."""
    folder: str
    parts: dict[int, list[tuple[str, int, int, int]]]


def drop(where: str | Sums) -> None:
    """Remove a folder of this module that no later job reads."""
    store, path = _place(where.folder if isinstance(where, Sums) else where)
    store.delete_dir_contents(path, missing_dir_ok=True)


@dataclass(frozen=True)
class TermSide:
    """Matrices (width x terms) of some models, one below the other in each file; ``version`` counts the rounds."""
    folder: str
    terms: int
    widths: dict[int, int]
    step: int  # terms a file
    version: int = 0

    @property
    def blocks(self) -> int:
        return -(-self.terms // self.step)

    def rows(self, model: int) -> slice:
        before = sum(w for m, w in self.widths.items() if m < model)
        return slice(before, before + self.widths[model])

    def file(self, block: int) -> str:
        return f"{self.folder}/{self.version}/{block}.npy"

    def take(self, model: int, wanted: np.ndarray) -> np.ndarray:
        """The model's columns of some terms (ascending)."""
        out, at = np.empty((self.widths[model], len(wanted))), self.rows(model)
        for b, a, z in self.cuts(wanted):
            out[:, a:z] = _load(self.file(b))[at][:, wanted[a:z] - b * self.step]
        return out

    def cuts(self, wanted: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(block, first, behind the last) of ascending terms."""
        if len(wanted):
            block = wanted // self.step
            edge = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(wanted)]])
            for a, z in zip(edge[:-1], edge[1:]):
                yield int(block[a]), int(a), int(z)


def create(spark: SparkSession, terms: int, widths: dict[int, int], of: Callable[[int, int, int], np.ndarray], name: str) -> TermSide:
    """The first version: ``of(model, first term, behind the last)`` gives the model's columns there."""
    widths = dict(sorted(widths.items()))
    step = max(1, BLOCK_BYTES // (8 * max(1, sum(widths.values()))))
    side = TermSide(scratch_path(spark, name), terms, widths, step)

    def write(batches):
        for batch in batches:
            for b in batch.column("id").to_pylist():
                low, high = b * step, min(terms, (b + 1) * step)
                _save(side.file(b), np.concatenate([of(m, low, high) for m in widths]))
            yield pa.RecordBatch.from_arrays([batch.column("id")], names=["id"])

    n = min(side.blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.range(0, side.blocks, 1, max(1, n)).mapInArrow(write, "id long").agg(F.count(F.lit(1))).collect()
    return side


def from_rows(rows: DataFrame, terms: int, widths: dict[int, int], name: str) -> TermSide:
    """The first version from (model, topic, term_idx, value) rows; what has no row is zero."""
    spark = rows.sparkSession
    side = create(spark, terms, widths, lambda m, low, high: np.zeros((widths[m], high - low)), name)

    folder = scratch_path(spark, "term-sums")

    def dense(group: pa.Table) -> pa.Table:
        b, m = group.column("block")[0].as_py(), group.column("model")[0].as_py()
        v = np.zeros((widths[m], min(terms, (b + 1) * side.step) - b * side.step))
        np.add.at(v, (np.asarray(group.column("topic")), np.asarray(group.column("term_idx")) - b * side.step), np.asarray(group.column("value")))
        file = uuid.uuid4().hex
        _save_flat(f"{folder}/{file}", [v])
        return pa.Table.from_batches([told([(file, [(b, m, v.size)])])])

    # A group holds at most the numbers of a block.
    cells = rows.select("model", "topic", "term_idx", "value").withColumn("block", F.expr(f"cast(term_idx div {side.step} as int)"))
    found = cells.groupBy("block", "model").applyInArrow(dense, TOLD).collect()
    return renew(spark, side, named(folder, [f for r in found for f in pickle.loads(r["told"])]), lambda m, old, num, extra, low: (num, None))[0]


TOLD = "told binary"


def told(what) -> pa.RecordBatch:
    """Something for the driver from a task."""
    return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(what)], pa.binary())], names=["told"])


def named(folder: str, files: list[tuple[str, list[tuple[int, int, int]]]]) -> Sums:
    """``files``: each with (block, model, size) of the arrays it holds, one behind the other."""
    parts: dict[int, list] = {}
    for file, held in files:
        at = 0
        for block, model, size in held:
            parts.setdefault(block, []).append((file, model, at, at + size))
            at += size
    return Sums(folder, parts)


class Partials:
    """What a task adds to blocks of a term side (rows as in ``width``); what is held goes to a file when it exceeds ``limit``."""

    def __init__(self, side: TermSide, width: dict[int, int], folder: str, limit: int):
        self.side, self.width, self.folder, self.limit = side, width, folder, limit
        self.held: dict[tuple[int, int], np.ndarray] = {}
        self.size, self.files = 0, []

    def add(self, model: int, terms: np.ndarray, num: np.ndarray) -> None:
        step = self.side.step
        for b, a, z in self.side.cuts(terms):
            if (b, model) not in self.held:
                self.held[b, model] = np.zeros((self.width[model], min(self.side.terms, (b + 1) * step) - b * step))
                self.size += self.held[b, model].nbytes
            self.held[b, model][:, terms[a:z] - b * step] += num[:, a:z]
        if self.size > self.limit:
            self.leave()

    def leave(self) -> list[tuple[str, list[tuple[int, int, int]]]]:
        if self.held:
            order, file = sorted(self.held), uuid.uuid4().hex
            _save_flat(f"{self.folder}/{file}", (self.held[key] for key in order))
            self.files.append((file, [(*key, self.held[key].size) for key in order]))
            self.held, self.size = {}, 0
        return self.files


def totals(packed: DataFrame | pk.Shelf, side: TermSide, models: list[int], add: Callable, extra: dict | None = None,
           width: dict[int, int] | None = None) -> tuple[dict[int, np.ndarray], Sums]:
    """(small, block sums) over all documents.

    ``add(rows, model, columns, extra)`` sees documents whose terms are numbered by
    the ``columns`` of the term side that they hold, and returns (sums for these
    columns, or None; a flat array of other sums). ``width``: rows of the sums, if
    not those of the term side.
    """
    spark = packed.sparkSession
    extra = extra or {}
    folder, width, limit = scratch_path(spark, "term-sums"), width or side.widths, pk.GROUP_BYTES

    def run(batches):
        partials = Partials(side, width, folder, limit)
        small: dict[int, np.ndarray] = {}
        for batch in batches:
            for rows in pk.slices(batch):
                whole, terms = rows.compact(side.terms)
                for m in models:
                    own = whole.of_model(m)
                    if not len(own.ends):
                        continue
                    num, rest = add(own, m, side.take(m, terms), extra.get(m))
                    small[m] = small[m] + rest if m in small else rest
                    if num is not None:
                        partials.add(m, terms, num)
        yield told((partials.leave(), small))

    # As many tasks as cores: each adds up what its documents have for a block before it leaves.
    return collected(folder, pk.tasks(packed, run, TOLD).collect())


def collected(folder: str, rows: list) -> tuple[dict[int, np.ndarray], Sums]:
    """(small, sums) of what the tasks of a pass told."""
    small: dict[int, np.ndarray] = {}
    files = []
    for r in rows:
        own, rest = pickle.loads(r["told"])
        files += own
        for m, v in rest.items():
            small[m] = small[m] + v if m in small else v
    return small, named(folder, files)


def renew(spark: SparkSession, side: TermSide, sums: Sums | None, of: Callable, extra: dict | None = None, widths: dict[int, int] | None = None,
          width: dict[int, int] | None = None, keep: bool = False, write: bool = True) -> tuple[TermSide, dict[int, np.ndarray]]:
    """(the next version, small): ``of(model, old columns, sums, extra, first term)`` gives (new columns, flat sums).

    ``sums``: where ``totals`` left them (a block without any has zeros; removed here but with ``keep``). ``widths``:
    of the new version. Without ``write`` the version stays and only ``small`` is of use.
    """
    extra, width = extra or {}, width or side.widths
    after = replace(side, version=side.version + 1, widths=dict(sorted((widths or side.widths).items()))) if write else side
    n = min(side.blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        small: dict[int, np.ndarray] = {}
        for batch in batches:
            for block in batch.column("id").to_pylist():
                got: dict[int, np.ndarray] = {}
                for file, m, first, last in sums.parts.get(block, ()) if sums else ():
                    v = load_part(f"{sums.folder}/{file}", first, last)
                    got[m] = got[m] + v if m in got else v
                low = block * side.step
                old, new = np.array(_load(side.file(block))), []
                for m in side.widths:
                    num = got[m].reshape(width[m], -1) if m in got else np.zeros((width[m], old.shape[1]))
                    columns, rest = of(m, old[side.rows(m)], num, extra.get(m), low)
                    new.append(columns)
                    if rest is not None:
                        small[m] = rest.combine(small.get(m)) if isinstance(rest, Folded) else small[m] + rest if m in small else rest
                if write:
                    _save(after.file(block), np.concatenate(new))
        yield told({m: v.flat() if isinstance(v, Folded) else v for m, v in small.items()})

    parts = spark.range(0, side.blocks, 1, max(1, n)).mapInArrow(run, TOLD).collect()
    if sums and not keep:
        drop(sums)
    if write:
        drop(f"{side.folder}/{side.version}")
    out: dict[int, list[np.ndarray]] = {}
    for r in parts:
        for m, v in pickle.loads(r["told"]).items():
            out.setdefault(m, []).append(v)
    return after, out


class Folded:
    """Flat sums of a block that aren't just added: the triangular factor of all rows so far (a tall-skinny QR), and sums."""

    def __init__(self, triangle: np.ndarray, sums: np.ndarray):
        self.triangle, self.sums = triangle, sums

    def combine(self, other: "Folded | None") -> "Folded":
        if other is None:
            return self
        return Folded(np.linalg.qr(np.vstack([other.triangle, self.triangle]), mode="r"), other.sums + self.sums)

    def flat(self) -> np.ndarray:
        b = self.triangle.shape[1]
        square = np.zeros((b, b))
        square[:len(self.triangle)] = self.triangle
        return np.concatenate([square.ravel(), self.sums])


def per_document(packed: DataFrame | pk.Shelf, side: TermSide, models: list[int], of: Callable, id_type: str, extra: dict | None = None) -> DataFrame:
    """(_nth, doc_id, v) with the number of the model and the row of numbers that ``of(rows, model, columns, extra)`` gives each member."""
    shipped = packed.sparkSession.sparkContext.broadcast(extra or {})

    def run(batches):
        for batch in batches:
            for rows in pk.slices(batch):
                whole, terms = rows.compact(side.terms)
                for m in models:
                    own = whole.of_model(m)
                    if len(own.ends):
                        v = of(own, m, side.take(m, terms), shipped.value.get(m))
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array([m] * len(v), pa.int32()), own.ids, lists], names=["model", "doc_id", "v"])

    return pk.mapped(packed, run, f"model int, doc_id {id_type}, v array<double>").withColumnRenamed("model", "_nth")


def table(spark: SparkSession, side: TermSide) -> DataFrame:
    """(_nth, topic, term_idx, value): the present version as rows, with the number of the model."""
    def read(batches):
        for batch in batches:
            for b in batch.column("id").to_pylist():
                values = np.array(_load(side.file(b)))
                low, n = b * side.step, values.shape[1]
                for m, w in side.widths.items():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(w * n, m, np.int32)), pa.array(np.repeat(np.arange(w, dtype=np.int32), n)),
                         pa.array(np.tile(np.arange(low, low + n, dtype=np.int32), w)), pa.array(values[side.rows(m)].ravel())],
                        names=["model", "topic", "term_idx", "value"])

    n = min(side.blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.range(0, side.blocks, 1, max(1, n)).mapInArrow(read, "model int, topic int, term_idx int, value double").withColumnRenamed("model", "_nth")


def uniform(entropy: list[int], rows: int, low: int, high: int) -> np.ndarray:
    """Numbers in (0, 1) of each (row, term): the same in whatever blocks they are made."""
    x = (np.arange(low, high, dtype=np.uint64)[None, :] * np.uint64(rows) + np.arange(rows, dtype=np.uint64)[:, None])
    for e in entropy:
        x = (x ^ np.uint64(e & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
