"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

``encode`` turns texts into pieces (length and checksum); ``pack`` gives each
piece a sequence and an offset by the linear grouping scheme:

1. large pieces are sorted by length and cut into groups of equal
   cardinality, each length rounded up to the longest of its group;
2. a configuration is a multiset of rounded lengths that fits a sequence; the
   linear programme over configurations is solved by column generation, the
   fractional rest by configurations that waste least;
3. actual pieces take the slots of their group;
4. small pieces, longest first, go where the least room is left that holds
   them, and what remains opens new sequences, best fit again.

Lengths are integers up to the capacity, so the plan is made on histograms of
at most ``capacity`` bins. The driver holds nothing that grows with the
documents; Spark ranks the pieces within their bin and looks each rank up in
the plan's intervals.

Null text is an empty text (one piece: the end token). Rows that repeat a
document id are separate documents if ``key`` tells them apart, and are ranked
arbitrarily but consistently otherwise. An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.indexing import ordered_index
from ..session import scratch_path
from . import words as wd

SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
# Byte classes between which a token always ends: letters, other ASCII, neither.
_LETTER, _OTHER = 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[33:127][_CLASS[33:127] == 0] = _OTHER
_CLASS[39] = 0  # an apostrophe may belong to either side
KEPT_WORDS = 500_000
SLICE = 5 << 20


class Encoder:
    """Token ids of whole texts by a tokenizer whose tokens never span white space.

    Texts are cut at white space and their distinct words between letters and
    ASCII signs, where the tokenizer always cuts too; each distinct cut is
    encoded once and kept, up to ``KEPT_WORDS`` of them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.stops = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.int32)

    def _learn(self, new: list[str]) -> None:
        ids, sizes = [], []
        plain, rest = [], []
        for w in new:  # letters only, before and after lower case: one run of letters each
            (plain if w.isalpha() and (w.isascii() or w.lower().isalpha()) else rest).append(w)
        order = []
        for a in range(0, len(plain), 4096):
            block = plain[a:a + 4096]
            got = self.whole(" ".join(block))
            stops = np.flatnonzero(self.ends[got]) + 1
            if len(stops) == len(block):
                order += block
                ids.append(got)
                sizes.append(np.diff(stops, prepend=0))
            else:
                rest += block
        for a in range(0, len(rest), 4096):
            block = rest[a:a + 4096]
            got = [e.ids for e in self.tok.encode_batch_fast(block, add_special_tokens=False)]
            order += block
            ids.append(np.array([i for g in got for i in g], np.int32))
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
        self.known.update(zip(order, range(len(self.known), len(self.known) + len(order))))
        self.stops = np.concatenate([self.stops, self.stops[-1] + np.cumsum(np.concatenate(sizes))])
        self.flat = np.concatenate([self.flat, *ids])

    def _encoded(self, names: list[str]) -> np.ndarray:
        """The number of each word in the store."""
        new = [w for w in names if w not in self.known]
        if new and len(self.known) + len(new) > KEPT_WORDS:
            self._forget()
            new = names
        if new:
            self._learn(new)
        return np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, where each word ends), for words without white space."""
        data, offsets = wd.text_bytes(words)
        kind = _CLASS[data]
        # The two bytes of U+00C0..U+00FF count as letters, but for the two signs among them.
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (kind[1:] | kind[:-1]) == (_LETTER | _OTHER)
        cut[offsets] = False
        cuts = np.flatnonzero(cut)
        spaced = np.insert(data, cuts, 32)
        parts, ends = wd.split(spaced, offsets + np.searchsorted(cuts, offsets), wd.AS_IS)
        coded = parts.dictionary_encode()
        number = self._encoded(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        ids, stops = gather(self.flat, self.stops, number)
        return ids, np.concatenate([[0], stops])[ends].astype(np.int64)

    def ids(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents in a row, where each document ends)."""
        words, ends = wd.split(raw, offsets, wd.LOWER)
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        coded = words.dictionary_encode()
        flat, stops = self._words(coded.dictionary)
        ids, upto = gather(flat, np.concatenate([[0], stops]), np.asarray(coded.indices))
        return ids, np.concatenate([[0], upto])[ends].astype(np.int64)


def gather(flat: np.ndarray, stops: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[stops[r]:stops[r + 1]]`` of all rows one after the other, and where each ends."""
    n = np.diff(stops)[rows]
    upto = np.cumsum(n)
    at = np.repeat(stops[:-1][rows] - (upto - n), n)
    at += np.arange(len(at))
    return flat[at], upto


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


PIECES = "piece int, start long, length long, ids_crc32 long"


def encode(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and,
    if asked for, ``ids``. A document's ids end with ``end_id``; only documents
    longer than ``capacity`` are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for rows, raw, off in wd.slices(batch.column("text"), SLICE):
                ids, ends = enc.ids(raw, off)
                text = raw.tobytes()
                odd = {i for i in range(len(ends)) if any(s in text[off[i]:off[i + 1]] for s in SPECIAL)} \
                    if any(s in text for s in SPECIAL) else ()
                doc, piece, start, length, crc, kept = [], [], [], [], [], []
                a = 0
                names = batch.column("doc_id").slice(rows.start, rows.stop - rows.start)
                for i, b in enumerate(ends):
                    own = enc.whole(text[off[i]:off[i + 1]].decode("utf-8", "replace")) if i in odd else ids[a:b]
                    own = np.append(own, end_id).astype("<u4")
                    a = b
                    for k, s in enumerate(range(0, len(own), capacity)):
                        cut = own[s:s + capacity]
                        doc.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                        if with_ids:
                            kept.append(cut.astype(np.int32))
                cols = {"doc_id": names.take(pa.array(doc, pa.int64())), "piece": pa.array(piece, pa.int32()),
                        "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    cols["ids"] = pa.array(kept, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return wd.in_batches(docs.select("doc_id", "text"), SLICE).mapInArrow(
        run, f"doc_id {kind}, {PIECES}" + (", ids array<int>" if with_ids else ""))


# -- the plan, on histograms ---------------------------------------------------------------------


def linear_groups(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[tuple[int, int, int]]:
    """(shortest, longest, pieces) of up to ``groups`` runs of lengths with about equal cardinality."""
    total, out, a, held = int(counts.sum()), [], 0, 0
    for i in range(len(lengths)):
        held += int(counts[i])
        if held * groups >= total or i == len(lengths) - 1:
            out.append((int(lengths[a]), int(lengths[i]), held))
            a, held = i + 1, 0
    return out


def best_configuration(sizes: np.ndarray, values: np.ndarray, room: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes within ``capacity`` of the greatest value, each at most ``room`` times."""
    best = np.zeros(capacity + 1)
    took = np.zeros((len(sizes), capacity + 1), np.int32)
    for i, s in enumerate(sizes):
        most = min(int(room[i]), capacity // int(s))
        base = best.copy()
        for c in range(1, most + 1):
            w = int(s) * c
            gain = base[:capacity + 1 - w] + values[i] * c
            better = gain > best[w:] + 1e-12
            best[w:][better] = gain[better]
            took[i, w:][better] = c
    out, w = np.zeros(len(sizes), np.int64), int(np.argmax(best))
    for i in range(len(sizes) - 1, -1, -1):
        out[i] = took[i, w]
        w -= int(sizes[i]) * int(out[i])
    return out


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(configuration, times) that hold exactly ``counts`` pieces of each size."""
    m = len(sizes)
    left = counts.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []
    if m == 0:
        return plan
    columns = np.diag(np.minimum(capacity // sizes, np.maximum(counts, 1))).astype(float)
    x = np.linalg.solve(columns, counts.astype(float))
    for _ in range(rounds):
        duals = np.linalg.solve(columns.T, np.ones(m))
        new = best_configuration(sizes, np.maximum(duals, 0.0), counts, capacity)
        if duals @ new <= 1 + 1e-7:
            break
        step = np.linalg.solve(columns, new.astype(float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1.0), np.inf)
        out = int(np.argmin(ratio))
        columns[:, out] = new
        x = np.maximum(np.linalg.solve(columns, counts.astype(float)), 0.0)
    for j in np.argsort(-x):
        config = columns[:, j].astype(np.int64)
        used = config > 0
        times = min(int(np.floor(x[j] + 1e-9)), int((left[used] // config[used]).min())) if used.any() else 0
        if times > 0:
            plan.append((config, times))
            left -= config * times
    while left.any():  # the rest: fill one sequence as full as can be, as often as that works
        config = best_configuration(sizes, sizes.astype(float), left, capacity)
        used = config > 0
        times = int((left[used] // config[used]).min())
        plan.append((config, times))
        left -= config * times
    return plan


def best_fit(rooms: dict[int, list[tuple[int, int]]], small: list[tuple[int, int]], first_new: int,
             capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Place small pieces, longest first, where the least sufficient room is left.

    ``rooms[r]`` lists intervals (first, n) of sequences with r tokens left;
    ``small`` lists (length, pieces). Gives (length, first rank, first
    sequence, n) moves: pieces of that length with ranks first rank .. + n go
    to the n sequences from first sequence. Opens sequences from ``first_new``.
    """
    moves = []
    free = np.zeros(capacity + 1, bool)
    free[[r for r, spans in rooms.items() if spans]] = True
    for length, n in sorted(small, reverse=True):
        rank = 0
        while n:
            fits = np.flatnonzero(free[length:])
            if not len(fits):
                # Open what the remaining pieces of this length need at most, a whole sequence's worth each.
                opened = -(-n // (capacity // length))
                rooms.setdefault(capacity, []).append((first_new, opened))
                free[capacity] = True
                first_new += opened
                continue
            r = length + int(fits[0])
            first, have = rooms[r].pop()
            take = min(n, have)
            if have > take:
                rooms[r].append((first + take, have - take))
            free[r] = bool(rooms[r])
            moves.append((length, rank, first, take))
            rooms.setdefault(r - length, []).append((first, take))
            free[r - length] = r > length
            rank += take
            n -= take
    return moves, first_new


def _lookup(intervals: np.ndarray, width: int):
    """A lookup of (bin, rank) in rows (bin, first rank, n, first sequence) sorted by bin and first rank."""
    keys = intervals[:, 0].astype(np.int64) * width + intervals[:, 1]

    def find(bins: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        row = np.searchsorted(keys, bins * width + ranks, side="right") - 1
        return intervals[row, 3] + (ranks - intervals[row, 1])
    return find


def _place(rows: DataFrame, bin_col: str, rank_col: str, intervals: list[tuple[int, int, int, int]]) -> DataFrame:
    """Add ``sequence_id`` by the plan's intervals. Their number is bounded by the capacity, not the rows."""
    width = 1 << 44
    table = np.array(sorted(intervals), np.int64).reshape(-1, 4)
    shipped = rows.sparkSession.sparkContext.broadcast(table)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        find = _lookup(shipped.value, width)
        for b in batches:
            if b.num_rows:
                seq = find(np.asarray(b.column(bin_col)).astype(np.int64), np.asarray(b.column(rank_col)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq, pa.int64())], names=[*b.schema.names, "sequence_id"])
    return rows.mapInArrow(run, f"{schema}, sequence_id long")


def pack(pieces: DataFrame, capacity: int = 4096, groups: int = 64, small: int | None = None,
         key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (a ``length`` of at most ``capacity``) with ``sequence_id`` and ``offset``.

    ``groups``: of equal cardinality among the large lengths; ``small``: up to
    which length a piece is packed last by best fit (default an eighth of the capacity).
    """
    spark = pieces.sparkSession
    small = capacity // 8 if small is None else small
    path = scratch_path(spark, "pieces")
    pieces.write.parquet(path)
    pieces = spark.read.parquet(path)
    bins = sorted((int(r[0]), int(r[1])) for r in pieces.groupBy("length").count().collect())  # at most capacity rows
    cols = pieces.columns
    large_bins = [(s, n) for s, n in bins if s > small]
    lengths = np.array([s for s, _ in large_bins], np.int64)
    counts = np.array([n for _, n in large_bins], np.int64)
    grouped = linear_groups(lengths, counts, groups) if len(lengths) else []
    plan = configurations(np.array([g[1] for g in grouped], np.int64), np.array([g[2] for g in grouped], np.int64), capacity)

    # Slots of each group, in the order of the plan: (group, first rank, n, first sequence).
    intervals, used, sequences = [], [0] * len(grouped), 0
    for config, times in plan:
        for g, c in enumerate(config):
            for _ in range(int(c)):
                intervals.append((g, used[g], times, sequences))
                used[g] += times
        sequences += times

    uppers = [g[1] for g in grouped]
    binned = pieces.withColumn("_bin", F.when(F.col("length") <= small, -F.col("length")).otherwise(_group_of(uppers)))
    ranked = ordered_index(binned, ["length", *key], "_rank", group_cols=["_bin"])
    ranked_path = scratch_path(spark, "ranked")
    ranked.write.parquet(ranked_path)
    ranked = spark.read.parquet(ranked_path)
    large = _place(ranked.where("_bin >= 0"), "_bin", "_rank", intervals)

    # Room left by the actual pieces; sequences of equal room are ranked, and the plan works on those ranks.
    room = large.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("_room"))
    room_path = scratch_path(spark, "room")
    ordered_index(room, ["sequence_id"], "_seat", group_cols=["_room"]).write.parquet(room_path)
    room = spark.read.parquet(room_path)
    free = sorted((int(r[0]), int(r[1])) for r in room.groupBy("_room").count().collect())  # at most capacity rows
    seats, rooms, base = [], {}, 0
    for r, n in free:
        seats.append((r, 0, n, base))
        if r:
            rooms[r] = [(base, n)]
        base += n
    moves, total = best_fit(rooms, [(s, n) for s, n in bins if s <= small], base, capacity)
    placed_small = _place(ranked.where("_bin < 0"), "_bin", "_rank",
                          [(-s, rank, n, first) for s, rank, first, n in moves])
    # Large pieces follow their sequence to its seat.
    renamed = room.select(F.col("sequence_id").alias("_old"), "_room", "_seat")
    seat_of = _place(renamed, "_room", "_seat", seats).select("_old", F.col("sequence_id").alias("_new"))
    large = large.join(seat_of, large["sequence_id"] == seat_of["_old"]).select(*cols, F.col("_new").alias("sequence_id"))
    both = large.unionByName(placed_small.select(*cols, "sequence_id"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *key).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def _group_of(uppers: list[int]):
    """The number of the first group whose longest length holds the piece."""
    edges = F.array(*[F.lit(int(u)).cast("long") for u in uppers]) if uppers else F.array().cast("array<bigint>")
    return F.aggregate(edges, F.lit(0).cast("long"), lambda n, u: n + F.when(F.col("length") > u, 1).otherwise(0))
