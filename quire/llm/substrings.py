"""Substring dedup: words covered by a window of ``size`` words that also starts earlier go.

1. Every partition sketches its windows: each window counts up one cell in
   each of ``DEPTH`` rows. The sketches are merged by ranges of cells; the
   least cell of a window is never under its count, so a window that occurs
   twice has every cell at two or more. Only that bit of a cell is kept.
2. Windows whose cells are all at two or more are grouped exactly, by 128
   hash bits, to their count and first place. Windows that the sketch took for
   repeated by mistake drop out here, and no repeated window can be missing.
3. Each document looks its windows up among the repeated ones and loses the
   words of those that start elsewhere earlier.

The rows of the sketch are as wide as the text has bytes, over two, so its
error is the same at every size. Its ranges and the tables of repeated windows
are sorted arrays in the shared folder, of bounded size each, mapped by the
tasks. A window that many documents share is one row a slice of text; no task
gets all its places.

Windows are judged on the input. Null text has no words. Rows that repeat a
document id are the same document: a window at the same place in both is not
earlier in either, and stays. A null id comes after all others. An empty table
gives no rows. Columns of the input that are called ``n_words`` or
``n_removed`` are replaced, all others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import arrays as ar
from . import words as wd

DEPTH = 2
SEGMENT = 23  # cells of a segment, as a power of two
SHARD_BYTES = 1 << 23  # of text for each table of repeated windows
SLICE = 4 << 20
LAST = np.iinfo(np.int64).max
BASES = (np.uint64(0x9E3779B97F4A7C55), np.uint64(0xC2B2AE3D27D4EB4F))


def window_hashes(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on (rolling over document ends, which the caller leaves out)."""
    base, n = BASES[seed], len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, span, held = ar.mix(words, seed), 1, base
        out, width = None, 0
        rest = size
        while True:
            if rest & 1:  # append the run of ``span`` words that starts after the ``width`` words so far
                out = power.copy() if out is None else out[:len(power) - width] * held + power[width:width + len(out)]
                width += span
            rest >>= 1
            if not rest:
                return ar.mix(out[:n], 7 + seed)
            power = power[:len(power) - span] * held + power[span:]
            held, span = held * held, span * 2


def windows(s: wd.Slice, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first hash, second hash, row in the slice, start in the document) of every window."""
    word = s.hashes()[s.codes] if len(s.codes) else np.zeros(0, np.uint64)
    n = np.maximum(s.counts - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = s.starts[doc] + start
    return window_hashes(word, size, 0)[at], window_hashes(word, size, 1)[at], doc, start


def cells(first: np.ndarray, row: int, width: int) -> np.ndarray:
    return ar.mix(first, 20 + row) & np.uint64(width - 1)


GAP = 0xFFFF


def gaps(places: np.ndarray) -> np.ndarray:
    """Sorted places as 16-bit steps; a step of 65535 moves on without a place."""
    step = np.diff(places, prepend=0)
    skips = step // GAP
    out = np.full(int((skips + 1).sum()), GAP, np.uint16)
    out[np.cumsum(skips + 1) - 1] = step % GAP
    return out


def places(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps.astype(np.int64))[steps != GAP]


class Sketch:
    """The merged sketch: which windows may occur twice."""

    def __init__(self, folder: str, width: int):
        self.folder, self.width = folder, width
        self.bits = min(SEGMENT, width.bit_length() - 1)

    def segment(self, row: int, k: int) -> str:
        return f"{self.folder}/sketch-{row}-{k}.npy"

    def repeated(self, first: np.ndarray) -> np.ndarray:
        """The indices of windows whose every cell has two or more."""
        left = np.arange(len(first))
        for row in range(DEPTH):
            cell = cells(first[left], row, self.width)
            keep = np.zeros(len(left), bool)
            for k, rows in ar.by_shard((cell >> np.uint64(self.bits)).astype(np.int64)):
                local = (cell[rows] & np.uint64((1 << self.bits) - 1)).astype(np.int64)
                # every segment that has a window was written when the sketch was merged
                keep[rows] = (ar.load(self.segment(row, k))[local >> 3] >> (local & 7)) & 1
            left = left[keep]
        return left


def build_sketch(docs: DataFrame, size: int, width: int, folder: str) -> Sketch:
    sketch = Sketch(folder, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in wd.word_slices(batch.column("text"), wd.AS_IS, SLICE):
                first = windows(s, size)[0]
                out = {"row": [], "segment": [], "steps": []}
                for row in range(DEPTH):
                    cell = np.sort(cells(first, row, width)).astype(np.int64)
                    again = np.append(False, cell[1:] == cell[:-1]) if len(cell) else np.zeros(0, bool)
                    third = again & np.append(False, again[:-1]) if len(cell) else again
                    cell = cell[~third]  # two of a cell are as good as more
                    at = np.flatnonzero(np.append(True, np.diff(cell >> sketch.bits) > 0)) if len(cell) else np.zeros(0, int)
                    for a, b in zip(at, np.append(at[1:], len(cell))):
                        out["row"].append(row)
                        out["segment"].append(int(cell[a] >> sketch.bits))
                        out["steps"].append(gaps(cell[a:b] & ((1 << sketch.bits) - 1)).view(np.int16))
                if out["row"]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out["row"], pa.int32()), pa.array(out["segment"], pa.int32()),
                         pa.array(out["steps"], pa.list_(pa.int16()))], names=list(out))

    def merge(group: pa.Table) -> pa.Table:
        row, k = group.column("row")[0].as_py(), group.column("segment")[0].as_py()
        every = np.sort(np.concatenate([
            places(np.asarray(x.values).view(np.uint16)).astype(np.int32) for x in group.column("steps")]))
        flags = np.zeros(max(8, 1 << sketch.bits), bool)
        flags[every[1:][every[1:] == every[:-1]]] = True
        ar.save(sketch.segment(row, k), np.packbits(flags, bitorder="little"))
        return pa.table({"row": pa.array([row], pa.int32()), "set": pa.array([int(flags.sum())], pa.int64())})

    (wd.in_batches(docs.select("text"), SLICE).mapInArrow(count, "row int, segment int, steps array<short>")
     .groupBy("row", "segment").applyInArrow(merge, "row int, set long").agg(F.sum("set")).collect())
    return sketch


class Firsts:
    """Sorted tables of the repeated windows and where each starts first."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards

    def file(self, shard: int, name: str) -> str:
        return f"{self.folder}/first-{shard}-{name}.npy"

    def shard(self, first: np.ndarray) -> np.ndarray:
        return (first % np.uint64(self.shards)).astype(np.int64)

    def earlier(self, first: np.ndarray, second: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether the window also starts at an earlier place."""
        out = np.zeros(len(first), bool)
        for k, rows in ar.by_shard(self.shard(first)):
            a, b, d, p = (ar.load(self.file(k, n)) for n in ("a", "b", "doc", "start"))
            if not len(a):
                continue
            at = np.searchsorted(a, first[rows])
            while True:  # past other windows with the same first half, if any
                here = np.minimum(at, len(a) - 1)
                other = (at < len(a)) & (a[here] == first[rows]) & (b[here] != second[rows])
                if not other.any():
                    break
                at = at + other
            here = np.minimum(at, len(a) - 1)
            known = (at < len(a)) & (a[here] == first[rows]) & (b[here] == second[rows])
            out[rows] = known & ((d[here] < doc[rows]) | ((d[here] == doc[rows]) & (p[here] < start[rows])))
        return out


def doc_ids(batch: pa.RecordBatch, rows: slice) -> np.ndarray:
    ids = batch.column("doc_id").slice(rows.start, rows.stop - rows.start)
    return np.asarray(pc.fill_null(ids.cast(pa.int64()), LAST))


def group_exactly(docs: DataFrame, size: int, sketch: Sketch, shards: int, folder: str) -> Firsts:
    firsts = Firsts(folder, shards)
    names = ("a", "b", "doc", "start", "n")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int16())

    def reduce(a, b, doc, start, n):
        """One row for each window: its first place and whether there are more."""
        order = np.lexsort((start, doc, b, a))
        a, b, doc, start, n = (x[order] for x in (a, b, doc, start, n))
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        total = np.add.reduceat(n.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        return a[at], b[at], doc[at], start[at], np.minimum(total, 2)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in wd.word_slices(batch.column("text"), wd.AS_IS, SLICE):
                first, second, doc, start = windows(s, size)
                pick = sketch.repeated(first)
                rows = reduce(first[pick], second[pick], doc_ids(batch, s.rows)[doc[pick]], start[pick], np.ones(len(pick), np.int64))
                shard, cols = [], [[] for _ in names]
                for k, at in ar.by_shard(firsts.shard(rows[0])):
                    shard.append(k)
                    for col, x in zip(cols, rows):
                        col.append((x[at].view(np.int64) if x.dtype == np.uint64 else x[at]))
                if shard:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard, pa.int32()),
                         *[pa.array([v.astype(t.to_pandas_dtype()) for v in c], pa.list_(t)) for c, t in zip(cols, kinds)]],
                        names=["shard", *names])

    def store(group: pa.Table) -> pa.Table:
        k = group.column("shard")[0].as_py()
        cols = [np.concatenate([np.asarray(x.values) for x in group.column(n)]) for n in names]
        a, b, doc, start, n = reduce(cols[0].view(np.uint64), cols[1].view(np.uint64), *cols[2:])
        twice = n > 1
        for name, x in zip(names, (a, b, doc, start)):
            ar.save(firsts.file(k, name), x[twice])
        return pa.table({"shard": pa.array([k], pa.int32()), "n": pa.array([int(twice.sum())], pa.int64())})

    schema = "shard int, a array<long>, b array<long>, doc array<long>, start array<long>, n array<short>"
    (wd.in_batches(docs.select("doc_id", "text"), SLICE).mapInArrow(gather, schema)
     .groupBy("shard").applyInArrow(store, "shard int, n long").agg(F.sum("n")).collect())
    return firsts


def deduplicate(docs: DataFrame, size: int = 20, rejoin: bool = True) -> DataFrame:
    """``docs`` with the kept words as ``text``, ``n_words`` and ``n_removed``.

    Kept words are joined by one space. With ``rejoin`` false a text that loses
    nothing stays as it was.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_removed")
    octets = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    width = 1 << max(16, (int(octets) // 2).bit_length())
    folder = scratch_path(spark, "substrings")
    sketch = build_sketch(docs, size, width, folder)
    firsts = group_exactly(docs, size, sketch, max(1, -(-int(octets) // SHARD_BYTES)), folder)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    text_at = docs.columns.index("text")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in wd.slices(batch.column("text"), SLICE):
                words, ends = wd.split(raw, off, wd.AS_IS)
                coded = words.dictionary_encode()
                s = wd.Slice(rows, np.asarray(coded.indices).astype(np.int64), ends, coded.dictionary)
                first, second, doc, start = windows(s, size)
                pick = sketch.repeated(first)
                first, second, doc, start = first[pick], second[pick], doc[pick], start[pick]
                gone = firsts.earlier(first, second, doc_ids(batch, rows)[doc], start)
                cover = np.zeros(len(s.codes) + 1, np.int64)
                at = s.starts[doc[gone]] + start[gone]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + size, -1)
                keep = np.cumsum(cover[:-1]) == 0
                kept_ends = np.concatenate([[0], np.cumsum(keep)])[ends].astype(np.int64)
                kept = wd.per_document(keep.astype(np.int64), ends)
                lists = pa.LargeListArray.from_arrays(
                    pa.array(np.concatenate([[0], kept_ends]), pa.int64()), words.filter(pa.array(keep)))
                text = pc.binary_join(lists, pa.scalar(" ", words.type)).cast(pa.string())
                part = batch.slice(rows.start, rows.stop - rows.start)
                if not rejoin:
                    text = pc.if_else(pa.array(kept == s.counts), part.column("text"), text)
                cols = list(part.columns)
                cols[text_at] = text
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(s.counts), pa.array(s.counts - kept)], names=[*part.schema.names, "n_words", "n_removed"])

    return wd.in_batches(docs, SLICE).mapInArrow(remove, f"{fields}, n_words long, n_removed long")
