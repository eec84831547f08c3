"""Prefix trie of conversations in minimal-perfect-hash node tables.

A node is a distinct sequence of first turns, named by a 128-bit digest of its
turns (each hashed with its place, so a long conversation's digests are running
totals over several tasks). Copies are counted once: conversations with the same
last digest become one path with a weight. All rows of a digest are compared by
parent, depth and SHA-256 of the last turn; if two sequences ever share a
digest, all is done again with another seed.

A node with one path is a tail: below it there is only that path, so its sums
follow from the path. The shared nodes go to shards by whole subtrees. A shard
gives each distinct digest a slot by a minimal perfect hash, checked against
the digest stored there, scatters what belongs to the nodes into flat arrays,
looks up the parents' slots and adds children to parents from the deepest
level up. Nodes with more paths than a shard should hold (there are at most
``paths / limit`` on a level) are the top: one more table of the same kind,
after the sums of the subtrees below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import arrays as ar
from .running import ordered

SPARE = 2  # cells a key of a level of the hash
SHARD_NODES = 1 << 20
PIECE = 4096  # ids hashed at a time
#: Bits of a digest's halves that count; tests make it small.
BITS = 64

ARRAYS = ("k1", "k2", "p1", "p2", "depth", "n_convs", "chars", "children", "leaves", "saved")


@dataclass
class Slots:
    """A minimal perfect hash of distinct 128-bit keys: every key has its own of ``len(k1)`` slots.

    A level is a bit array; a key whose cell no other key of the level wants
    sets the bit, the rest go to the next level. The slot is the number of bits
    before it.
    """
    k1: np.ndarray  # by slot
    k2: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # (bits, slots before each)

    @classmethod
    def build(cls, k1: np.ndarray, k2: np.ndarray) -> "Slots":
        out, taken = cls(np.zeros(len(k1), np.int64), np.zeros(len(k1), np.int64)), 0
        a, b = k1, k2
        while len(a):
            cell = out._cell(a, b, len(out.levels), SPARE * len(a))
            bits = np.bincount(cell, minlength=SPARE * len(a)) == 1
            before = taken + np.cumsum(bits) - bits
            out.levels.append((bits, before))
            alone = bits[cell]
            slot = before[cell[alone]]
            out.k1[slot], out.k2[slot] = a[alone], b[alone]
            taken += int(bits.sum())
            a, b = a[~alone], b[~alone]
        return out

    @staticmethod
    def _cell(k1: np.ndarray, k2: np.ndarray, level: int, cells: int) -> np.ndarray:
        mixed = ar.mix(k1.view(np.uint64) ^ ar.mix(k2.view(np.uint64), 2 * level + 1), 2 * level)
        return (mixed % np.uint64(cells)).astype(np.int64)

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 for keys that aren't in the table."""
        out = np.full(len(k1), -1, np.int64)
        left = np.arange(len(k1))
        for level, (bits, before) in enumerate(self.levels):
            cell = self._cell(k1[left], k2[left], level, len(bits))
            out[left[bits[cell]]] = before[cell[bits[cell]]]
            left = left[~bits[cell]]
        at = np.flatnonzero(out >= 0)
        wrong = (self.k1[out[at]] != k1[at]) | (self.k2[out[at]] != k2[at])
        out[at[wrong]] = -1
        return out


def accumulate(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """By slot: the nodes with children, leaves and saved of their whole subtrees.

    ``rows``: a node's row has its own numbers and what subtrees outside the
    table add to it (``children``, ``leaves``, ``saved``).
    """
    order = np.lexsort((rows["k2"], rows["k1"]))
    k1, k2 = rows["k1"][order], rows["k2"][order]
    new = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))[:len(k1)]
    slots = Slots.build(k1[new], k2[new])
    at = slots.find(rows["k1"], rows["k2"])
    if (at < 0).any() or not new.all():
        raise ValueError("a digest without a slot of its own")
    out = {}
    for name, column in rows.items():
        out[name] = np.zeros(len(slots.k1), np.int64)
        np.add.at(out[name], at, column)
    parent = slots.find(out["p1"], out["p2"])
    parent[out["depth"] == 0] = -1
    inner = np.flatnonzero(parent >= 0)
    np.add.at(out["children"], parent[inner], 1)
    out["saved"] += (out["n_convs"] - 1) * out["chars"]
    by_depth = np.argsort(-out["depth"], kind="stable")
    cuts = np.flatnonzero(np.diff(out["depth"][by_depth])) + 1
    for level in np.split(by_depth, cuts):
        bare = level[out["children"][level] == 0]
        out["leaves"][bare] = 1
        up = level[parent[level] >= 0]
        np.add.at(out["leaves"], parent[up], out["leaves"][up])
        np.add.at(out["saved"], parent[up], out["saved"][up])
    return out


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        rows = pa.Table.from_batches(held)
        names = (*ARRAYS, "conv_id")
        out = accumulate({n: np.array(rows.column(n), np.int64) for n in names})
        yield pa.RecordBatch.from_arrays([pa.array(out[n]) for n in names], names=list(names))


def _paths(turns: DataFrame, seed: int) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, turn, chars, upto): every prefix of every conversation."""
    place = F.col("place").cast("bigint")
    rows = turns.select("conv_id", place.alias("place"), F.char_length("text").cast("bigint").alias("chars"),
                        F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256).alias("turn"))
    mask = F.lit((1 << BITS) - 1 if BITS < 64 else -1).cast("bigint")
    for half in (1, 2):
        rows = rows.withColumn(f"h{half}", F.xxhash64(F.lit(2 * seed + half), "place", "turn").bitwiseAND(mask))
    run = ordered(rows, "conv_id", [F.col("place")], {
        "k1": ("xor", F.col("h1")), "k2": ("xor", F.col("h2")), "upto": ("sum", F.col("chars"))}, "trie-paths")
    return run.select("conv_id", (F.col("pos") + 1).alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"),
                      F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "turn", "chars", "upto")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _digests_of_ids(ends: DataFrame, shards: int) -> DataFrame:
    """(k1, k2, ends_sha256): the ids of each key, ascending, in decimal and joined by commas, hashed as a stream."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, ids = (np.array(batch.column(n), np.int64) for n in ("k1", "k2", "conv_id"))
            cut = np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1
            out = [(int(k1[at[0]]), int(k2[at[0]]), int(ids[at[0]]), ",".join(map(str, ids[at].tolist())))
                   for level in np.split(np.arange(len(ids)), cut) for at in (level[j:j + PIECE] for j in range(0, len(level), PIECE))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["k1", "k2", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for a, b, ids in zip(*(batch.column(n).to_pylist() for n in ("k1", "k2", "ids"))):
                if key != (a, b):
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if len(out) >= PIECE:
                yield result(out)
                out = []
        if key:
            yield result([*out, (*key, state.hexdigest())])

    def result(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds[:2] + kinds[3:])], names=["k1", "k2", "ends_sha256"])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    sorted_ids = ends.select("k1", "k2", "conv_id").repartitionByRange(shards, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    parts = sorted_ids.mapInArrow(pieces, "k1 long, k2 long, first long, ids string")
    return parts.repartition(shards, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def build(convs: DataFrame, turns: DataFrame, limit: int | None = None) -> DataFrame:
    """The nodes of the trie of conversations, root included; none if there are no conversations.

    ``convs``: ``conv_id`` of every conversation, each once, not null. ``turns``:
    ``conv_id, place, role, text`` without nulls, places 0, 1, .. of each
    conversation; a conversation may have none. Other columns play no part.

    Returns ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null
    for the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256``; (conv_id, depth) names a node. ``limit``: paths through a
    node from which on it belongs to the top.
    """
    spark = convs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for seed in range(8):
        paths = _written(_paths(turns, seed), "trie-prefixes")
        if not _exact(paths):
            continue
        last = paths.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2", "upto")).alias("last"))
        whole = _written(convs.select("conv_id").join(last, "conv_id", "left").select(
            "conv_id", F.coalesce("last.depth", F.lit(0).cast("bigint")).alias("len"), *[
                F.coalesce(f"last.{c}", F.lit(0).cast("bigint")).alias(c) for c in ("k1", "k2")],
            F.coalesce("last.upto", F.lit(0).cast("bigint")).alias("total")), "trie-whole")
        same = whole.groupBy("k1", "k2").agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.min("len").alias("len"), F.min("total").alias("total"))
        weighted = _written(paths.join(same.select("conv_id", "weight", "len", "total"), "conv_id"), "trie-weighted")
        nodes = _written(weighted.groupBy("k1", "k2").agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("paths"), F.sum("weight").alias("n_convs"),
            *[F.min(c).alias(c) for c in ("p1", "p2", "depth", "chars", "len")],
            F.min(F.col("total") - F.col("upto") + F.col("chars")).alias("rest")), "trie-nodes")
        break
    else:
        raise ValueError("digests of different conversations are equal for every seed")

    root = whole.agg(F.min("conv_id").alias("conv_id"), F.countDistinct("k1", "k2").alias("paths"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("bigint")
    root = root.select(*[zero.alias(c) for c in ("k1", "k2", "p1", "p2", "depth", "chars")], "conv_id", "paths", "n_convs")
    tails = nodes.where("paths = 1")
    tail_rows = tails.select("k1", "k2", "p1", "p2", "conv_id", "depth", "n_convs", F.when(F.col("depth") < F.col("len"), 1).otherwise(0).cast("bigint").alias("children"),
                             F.lit(1).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("rest")).alias("saved"))
    shared = nodes.where("paths > 1").select(root.columns).unionByName(root)
    shared = _written(shared.join(_sums(tail_rows), ["k1", "k2"], "left").na.fill(0, ["children", "leaves", "saved"]), "trie-shared")
    counts = shared.agg(F.max("paths").alias("paths"), F.count(F.lit(1)).alias("nodes")).first()
    limit = limit or max(64, (counts["paths"] or 0) // (4 * shards))
    top = shared.where((F.col("paths") > limit) | (F.col("depth") == 0))
    below = shared.where((F.col("paths") <= limit) & (F.col("depth") > 0))
    # At most paths / limit digests a level.
    heads = top.select("k1", "k2")
    first_below = (weighted.select("conv_id", "k1", "k2", "p1", "p2")
                   .join(F.broadcast(heads.withColumnsRenamed({"k1": "p1", "k2": "p2"})), ["p1", "p2"], "left_semi")
                   .join(F.broadcast(heads), ["k1", "k2"], "left_anti").select("conv_id", F.col("k1").alias("r1"), F.col("k2").alias("r2")))
    n = max(shards, -(-counts["nodes"] // SHARD_NODES))
    schema = ", ".join(f"{c} long" for c in (*ARRAYS, "conv_id"))
    names = [*ARRAYS, "conv_id"]
    done = _written(below.join(first_below, "conv_id").repartition(n, "r1", "r2").select(names).mapInArrow(_tables, schema), "trie-below")
    under = _sums(done).withColumnsRenamed({"children": "c", "leaves": "l", "saved": "s"})
    top_rows = top.join(under, ["k1", "k2"], "left").select(
        *[c for c in names if c not in ("children", "leaves", "saved")],
        *[(F.col(a) + F.coalesce(F.col(b), zero)).alias(a) for a, b in (("children", "c"), ("leaves", "l"), ("saved", "s"))])
    finished = _written(top_rows.select(names).coalesce(1).mapInArrow(_tables, schema), "trie-top")

    cols = ["k1", "k2", "p1", "p2", "conv_id", "depth", "n_convs", "children", "leaves", "saved"]
    every = tail_rows.select(cols).unionByName(done.select(cols)).unionByName(finished.select(cols))
    owner = lambda t, c: t.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias(c))
    every = every.join(F.broadcast(owner(finished, "_top")), ["p1", "p2"], "left").join(owner(done, "_shared"), ["p1", "p2"], "left")
    ends = _digests_of_ids(whole, shards)
    none = hashlib.sha256(b"").hexdigest()
    return every.join(ends, ["k1", "k2"], "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("_top", "_shared", "conv_id")).alias("parent_conv_id"), "n_convs",
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def _sums(nodes: DataFrame) -> DataFrame:
    """What nodes add to their parents, by the parent's digest."""
    return nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _exact(paths: DataFrame) -> bool:
    """Whether equal digests have equal parents, depths and last turns (so equal sequences, from the root down), and none is the root's."""
    unlike = [F.min(c) != F.max(c) for c in ("p1", "p2", "depth", "turn")]
    found = paths.groupBy("k1", "k2").agg((unlike[0] | unlike[1] | unlike[2] | unlike[3]).alias("unlike"))
    return found.where("unlike or (k1 = 0 and k2 = 0)").isEmpty()
