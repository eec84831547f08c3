"""The vocabulary as mapped files, and documents' terms looked up in it inside their rows.

A vocabulary is written once to the shared folder, dealt to files of at most some
``SHARD_TERMS`` terms by the leading bits of the terms' hashes and sorted by hash in
each. A task maps the files and finds the terms of a slice of documents by binary
search; each hit's characters are compared, so equal hashes decide nothing.
Neither driver nor a task holds the vocabulary whole, and no (document, term) pair
is shuffled.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import blocks as bl

SHARD_TERMS = 1 << 16
SLICE_TERMS = 1 << 19  # terms handled at a time inside a batch
BATCH_BYTES = 8 << 20  # of documents in an Arrow batch, which stands several times in a task

drop = bl.drop


def _file(folder: str, shard: int) -> str:
    return f"{folder}/{shard}.arrow"


@lru_cache(maxsize=256)
def _load(uri: str) -> pa.Table:
    store, path = bl._place(uri)
    if isinstance(store, fs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(path)).read_all()
    with store.open_input_file(path) as src:
        return pa.ipc.open_file(io.BytesIO(src.read())).read_all()


def publish(vocab: DataFrame) -> tuple[str, int, list[int]]:
    """(folder, leading bits of the hash that name a file, the files) of a vocabulary (term_idx, term, idf)."""
    spark = vocab.sparkSession
    folder = scratch_path(spark, "terms")
    bits = max(0, (vocab.count() * 2 // SHARD_TERMS).bit_length())
    key = F.xxhash64("term")
    shard = F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)

    def write(group: pa.Table) -> pa.Table:
        n = group.column("shard")[0].as_py()
        group = group.drop_columns(["shard"]).sort_by("key").combine_chunks()
        store, path = bl._place(_file(folder, n))
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part) as out, pa.ipc.new_file(out, group.schema) as file:
            file.write_table(group)
        store.move(part, path)
        return pa.table({"shard": pa.array([n], pa.int32())})

    dealt = vocab.select(shard.alias("shard"), key.alias("key"), "term_idx", "term", "idf")
    return folder, bits, sorted(r["shard"] for r in dealt.groupBy("shard").applyInArrow(write, "shard int").collect())


def find(terms: pa.Array, keys: np.ndarray, where: tuple[str, int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(index, -1 for terms that the vocabulary lacks; idf) of terms with their hashes."""
    folder, bits, files = where
    index, idf = np.full(len(keys), -1, np.int32), np.zeros(len(keys))
    shard = (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    order = np.argsort(shard, kind="stable")
    edge = np.searchsorted(shard[order], np.arange((1 << bits) + 1))
    for n in files:
        at = order[edge[n]:edge[n + 1]]
        if not len(at):
            continue
        table = _load(_file(folder, n))
        known, words = table.column("key").to_numpy(), table.column("term")
        place = np.searchsorted(known, keys[at])
        while len(at):  # more than once only where hashes are equal
            here = place < len(known)
            at, place = at[here], place[here]
            here = known[place] == keys[at]
            at, place = at[here], place[here]
            if len(at):
                same = pc.equal(words.take(pa.array(place)), terms.take(pa.array(at))).to_numpy()
                index[at[same]] = table.column("term_idx").to_numpy()[place[same]]
                idf[at[same]] = table.column("idf").to_numpy()[place[same]]
                at, place = at[~same], place[~same] + 1
    return index, idf


def _indexed(batch: pa.RecordBatch, where: tuple, tfidf: bool, norm: bool) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    words, tfs, keys = (batch.column(c).flatten() for c in ("words", "tfs", "keys"))
    a = 0
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE_TERMS, side="right")) - 1))
        cut = slice(ends[a], ends[b])
        own = words.slice(ends[a], ends[b] - ends[a])
        index, idf = find(own, np.asarray(keys)[cut], where)
        doc = np.repeat(np.arange(b - a), np.diff(ends[a:b + 1]))
        kept = np.flatnonzero(index >= 0)
        doc, index, tf = doc[kept], index[kept], np.asarray(tfs)[cut][kept]
        order = np.lexsort((index, doc))
        doc, index, tf, kept = doc[order], index[order], tf[order], kept[order]
        weight = tf * idf[kept] if tfidf else tf.astype(np.float64)
        if norm:
            weight = weight / np.sqrt(np.bincount(doc, weight ** 2, b - a))[doc]
        offsets = pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, v) for v in (pa.array(index), pa.array(tf), pa.array(weight))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a), *lists],
                                         names=["doc_id", "label", "terms", "tfs", "weights"])
        a = b


def index_rows(counted: DataFrame, where: tuple[str, int, list[int]], tfidf: bool, norm: bool) -> DataFrame:
    """(doc_id, label, terms, tfs, weights) of documents' (doc_id, label, words, tfs): what the vocabulary holds, in its order."""
    kinds = {f.name: f.dataType.simpleString() for f in counted.schema.fields}
    counted.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        for batch in batches:
            yield from _indexed(batch, where, tfidf, norm)

    keyed = counted.select("doc_id", "label", "words", "tfs", F.transform("words", lambda w: F.xxhash64(w)).alias("keys"))
    return keyed.mapInArrow(run, f"doc_id {kinds['doc_id']}, label {kinds['label']}, terms array<int>, tfs array<bigint>, weights array<double>")
