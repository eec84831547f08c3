"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are 64 majority bits over the XXH64 hashes of a text's word
shingles. Equal fingerprints collapse to one row. The rest are laid out in
tiles of equal population counts (the bit counts of the four 16-bit quarters);
a pair of tiles whose counts differ by more than the radius in sum cannot hold
a link and is never formed. Every other pair of tiles is compared whole with
numpy's exclusive-or and bit count, so no link is lost.

A task gets two tiles of at most about ``TILE`` fingerprints. It reports the
links it found as a star for each group they join, so a group of n near copies
costs at most n links in a pair of tiles and never n * n rows.

The comparison is exact and therefore grows with the square of the distinct
fingerprints, thinned by the counts (about one pair of tiles in twenty).

Null and empty texts have fingerprint zero, linked like any other. Rows that
repeat a document id are fingerprinted each on their own. A null id never
becomes a component id unless all ids it links to are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import words as wd
from .graph import components

SEED = 42
TILE = 2048
SLICE = 2 << 20
QUARTERS = 4


def shingle_hashes(words: pa.Array, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of all shingles, where each document's end). Fewer words than ``size`` make one shingle."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    n = ends - starts
    short = (n > 0) & (n < size)
    each = np.where(n >= size, n - size + 1, short.astype(np.int64))
    upto = np.cumsum(each)
    total = int(upto[-1]) if len(upto) else 0
    first = np.repeat(starts - (upto - each), each) + np.arange(total)
    digest = xxhash.xxh64_intdigest
    out = np.zeros(total, np.uint64)
    whole = ~np.repeat(short, each)
    at = first[whole]
    if len(at):
        joined = pc.binary_join_element_wise(*[words.take(pa.array(at + k)) for k in range(size)],
                                             pa.scalar(" ", words.type)).cast(pa.large_binary())
        out[whole] = np.fromiter((digest(s, SEED) for s in joined.to_pylist()), np.uint64, len(at))
    for d in np.flatnonzero(short):
        text = " ".join(words.slice(int(starts[d]), int(n[d])).to_pylist())
        out[upto[d] - 1] = digest(text.encode(), SEED)
    return out, upto


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if it is set in over half of the document's hashes."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    n = ends - starts
    out = np.zeros(len(ends), np.uint64)
    full = np.flatnonzero(n > 0)
    if not len(full):
        return out
    votes = np.zeros((len(full), 64), np.int64)
    block = 1 << 18  # hashes at a time: the bits of a very long text are never all unpacked at once
    a = 0
    while a < len(full):
        b = max(a + 1, int(np.searchsorted(ends[full], starts[full[a]] + block, side="right")))
        if b == a + 1 and n[full[a]] > block:
            for s in range(int(starts[full[a]]), int(ends[full[a]]), block):
                votes[a] += _bits(hashes[s:min(s + block, int(ends[full[a]]))]).sum(0, dtype=np.int64)
        else:
            lo, hi = int(starts[full[a]]), int(ends[full[b - 1]])
            votes[a:b] = np.add.reduceat(_bits(hashes[lo:hi]), starts[full[a:b]] - lo, axis=0, dtype=np.int32)
        a = b
    bits = (2 * votes > n[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u8")
    return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(docs: DataFrame, size: int = 3, others: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``others`` and ``fp`` (the 64 bits as a long) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in wd.slices(batch.column("text"), SLICE):
                words, ends = wd.split(raw, off, wd.LOWER)
                fp = majority(*shingle_hashes(words, ends, size))
                part = [batch.column(c).slice(rows.start, rows.stop - rows.start) for c in names]
                yield pa.RecordBatch.from_arrays([*part, pa.array(fp.view(np.int64))], names=[*names, "fp"])

    names = ["doc_id", *others]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return wd.in_batches(docs.select(*names, "text"), SLICE).mapInArrow(run, f"{kinds}, fp long")


def _quarter(fp: Column, k: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)))


def offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts that sum to at most ``radius``, one of each pair of opposites."""
    spans: list[tuple[int, ...]] = [()]
    for _ in range(QUARTERS):
        spans = [(*s, d) for s in spans for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    return [s for s in spans if s >= (0,) * QUARTERS]


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Star links (node, centre) among the fingerprints of two tiles within ``radius``."""
    nodes = a if same else np.concatenate([a, b])
    base = 0 if same else len(a)
    label = np.arange(len(nodes))
    rows = max(1, (1 << 18) // max(1, len(b)))
    found = False
    for s in range(0, len(a), rows):
        near = np.bitwise_count(a[s:s + rows, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i = i + s
        j = j + base
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            found = True
            while True:  # merge the labels that these links join
                x, y = label[i], label[j]
                low, high = np.minimum(x, y), np.maximum(x, y)
                if (low == high).all():
                    break
                np.minimum.at(label, high, low)
                while (label[label] != label).any():
                    label = label[label]
    if not found:
        return nodes[:0], nodes[:0]
    tied = np.flatnonzero(label != np.arange(len(label)))
    return nodes[tied], nodes[label[tied]]


def links(prints: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join all distinct values of ``fp`` within ``radius`` bits, transitively."""
    spark = prints.sparkSession
    counts = [f"q{k}" for k in range(QUARTERS)]
    laid = prints.select("fp", *[_quarter(F.col("fp"), k).alias(c) for k, c in enumerate(counts)])
    # At most 17 ** 4 classes of population counts, whatever the input; each is cut into tiles by a hash.
    sizes = laid.groupBy(*counts).agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("tiles"))
    path = scratch_path(spark, "tiles")
    (laid.join(F.broadcast(sizes), counts)
     .groupBy(*counts, F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("tile"))
     .agg(F.collect_list("fp").alias("fps")).write.parquet(path))
    tiles = spark.read.parquet(path)
    steps = F.array(*[F.array(*[F.lit(d) for d in s]) for s in offsets(radius)])
    sent = tiles.select("*", F.explode(steps).alias("d")).select(
        *[(F.col(c) + F.col("d")[k]).alias(c) for k, c in enumerate(counts)],
        F.col("tile").alias("from_tile"), F.col("fps").alias("b"),
        F.forall("d", lambda x: x == 0).alias("home"))
    pairs = (tiles.select(*counts, "tile", F.col("fps").alias("a")).join(sent, counts)
             .where("not home or tile <= from_tile")
             .select("a", "b", (F.col("home") & (F.col("tile") == F.col("from_tile"))).alias("same")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            left, right, same = batch.column("a"), batch.column("b"), batch.column("same").to_pylist()
            lo, ro = np.asarray(left.offsets), np.asarray(right.offsets)
            lv, rv = (np.asarray(c.values).view(np.uint64) for c in (left, right))
            for k in range(batch.num_rows):
                x, y = close_pairs(lv[lo[k]:lo[k + 1]], rv[ro[k]:ro[k + 1]], radius, same[k])
                if len(x):
                    xs.append(x)
                    ys.append(y)
            if xs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (xs, ys)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _components(prints: DataFrame, radius: int) -> DataFrame:
    """``fp``, ``component`` (a fingerprint of it) and ``least`` (id) of every distinct fingerprint."""
    spark = prints.sparkSession
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    group = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    placed = distinct.join(group, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    table = scratch_path(spark, "components")
    placed.write.parquet(table)
    return spark.read.parquet(table)


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest id that
    links of at most ``radius`` bits reach) of every row."""
    spark = docs.sparkSession
    path = scratch_path(spark, "fingerprints")
    fingerprints(docs, size).write.parquet(path)
    prints = spark.read.parquet(path)
    placed = _components(prints, radius)
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    lookup = scratch_path(spark, "named")
    placed.join(named, "component").select("fp", "component_id").write.parquet(lookup)
    return (prints.join(spark.read.parquet(lookup), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def drop_near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the one with the smallest id (null last; of rows that share it,
    the one whose text has the least hash).

    Rows are told apart by id and text, so rows that share an id but not their text's component all have a say, rows
    without an id are judged like the others, and of wholly equal rows one stays.
    """
    spark = docs.sparkSession
    # 128 bits of the text; the last names the row in joins, where a null id is an id like others.
    marks = {"_near_1": F.xxhash64("text"), "_near_2": F.xxhash64(F.lit(1), "text"), "_near_id": F.xxhash64(F.col("doc_id").isNull(), "doc_id")}
    key = [*marks]
    path = scratch_path(spark, "near-duplicates")
    fingerprints(docs.select("doc_id", "text").withColumns(marks), size, (*key,)).write.parquet(path)
    prints = spark.read.parquet(path)
    rows = prints.join(_components(prints, radius).select("fp", "component"), "fp")
    # Copies of a row are one here, with their number.
    rows = rows.groupBy("component", "doc_id", *key).agg(F.count(F.lit(1)).alias("copies"))
    table = scratch_path(spark, "judged")
    rows.write.parquet(table)
    rows = spark.read.parquet(table)
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", *key)).alias("first"))
    # Joined by row, not by component: one of them may hold a third of the rows.
    judged = rows.select(*key, "copies").join(first.select("first.*").select(*key, F.lit(True).alias("stays")), key, "left").fillna(False, ["stays"])
    kept = scratch_path(spark, "kept")
    judged.where("not stays or copies > 1").select(*key, "stays").write.parquet(kept)
    odd = spark.read.parquet(kept)
    marked = docs.withColumns(marks)
    # The list grows with the corpus, so the texts meet it in a shuffle join at every size.
    single = marked.join(odd.select(*key).hint("merge"), key, "left_anti")
    again = marked.join(odd.where("stays").select(*key), key, "left_semi").dropDuplicates(key)
    return single.select(*docs.columns).unionByName(again.select(*docs.columns))
