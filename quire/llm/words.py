"""Words of whole texts as integer codes, a slice of an Arrow batch at a time.

A slice holds as many whole documents as fit a byte limit, and one document
at least, so memory follows the limit and the longest single document.
Splitting and coding run in Arrow's kernels on the UTF-8 bytes; null text is
an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

SLICE_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
UPPER = np.arange(65, 91)


def _table(space=()) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[UPPER] += 32
    t[list(space)] = 32
    return t


AS_IS = None
#: A-Z to lower case, all else as it is.
LOWER = _table()
#: Also every ASCII character but digits and letters to a space.
ALNUM = _table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


@dataclass
class Slice:
    rows: slice  # of the batch
    codes: np.ndarray  # of all words, document after document
    ends: np.ndarray  # where each document's words end in codes
    names: pa.Array  # the distinct words, by code

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    @property
    def counts(self) -> np.ndarray:
        return self.ends - self.starts

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each distinct word."""
        digest = xxhash.xxh64_intdigest
        raw = self.names.cast(pa.binary()).to_pylist()
        return np.fromiter((digest(w, seed) for w in raw), np.uint64, len(raw))


def in_batches(docs: DataFrame, limit: int = SLICE_BYTES) -> DataFrame:
    """``docs``, with the session's limit on the bytes of an Arrow batch lowered to ``limit``.

    Batches of the default 64 MB stand several times in an executor: in the
    JVM, in the pipe and in each Python worker, beside what is made of them.
    """
    conf = docs.sparkSession.conf
    now = conf.get(BATCH_CONF).removesuffix("b")
    if not now.isdigit() or int(now) > limit:
        conf.set(BATCH_CONF, str(limit))
    return docs


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) with at most ``limit`` bytes unless one document is longer."""
    raw, off = text_bytes(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield slice(a, b), raw[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b
    pa.default_memory_pool().release_unused()  # workers live on: what one batch needed goes back


def split(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray | None) -> tuple[pa.Array, np.ndarray]:
    """(words, ends) of the texts: maximal runs without \\x20 and \\x09-\\x0D after the byte table."""
    data = raw if table is None else table[raw]
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)),
                                             pa.py_buffer(np.ascontiguousarray(data)))
    parts = pc.ascii_split_whitespace(texts)
    ends = np.asarray(parts.offsets)[1:].astype(np.int64)
    words = parts.values
    empty = np.asarray(pc.equal(pc.binary_length(words), 0)) if len(words) else np.zeros(0, bool)
    if empty.any():
        words = words.filter(pa.array(~empty))
        ends = ends - np.concatenate([[0], np.cumsum(empty)])[ends]
    return words, ends


def word_slices(column: pa.Array, table: np.ndarray | None, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    for rows, raw, offsets in slices(column, limit):
        words, ends = split(raw, offsets, table)
        coded = words.dictionary_encode()
        yield Slice(rows, np.asarray(coded.indices).astype(np.int64), ends, coded.dictionary)


def per_document(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the values of each document."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]]).astype(np.int64)]
