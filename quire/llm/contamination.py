"""Benchmark decontamination by suffix arrays of the training text.

The training text is cut into shards of whole documents. A shard's suffix
array orders all its suffixes by words (by doubling, to the depth of the
longest test item); every suffix of every test item is found in it by binary
search. So the suffixes of both are in one order, in which each suffix of the
text has its longest verbatim match beside it. Words
inside an occurrence of a test window (``window`` consecutive words of an
item, or a shorter item whole) are hit.

Shards live in the task that reads their documents. The test items are
written once to the shared folder as arrays, in blocks of bounded size; a task
takes the blocks one after the other, so a benchmark may be of any size.

Null text has no words; an item or document without words matches nothing.
Repeated items are items of their own. Rows that repeat a document id are
judged each on their own. An empty table gives no rows; without items nothing
is hit. Columns of the input with the names of added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import arrays as ar
from . import words as wd

SHARD = 4 << 20  # bytes of training text in one suffix array, but for a longer document
BLOCK_WORDS = 1 << 18  # of test items searched at a time


#: Stands for a missing item id; greater than any that occurs, so that the least id of several is a real one.
NO_ID = np.iinfo(np.int64).max


@dataclass
class Items:
    """A block of test items: word hashes, where each item ends, item ids (``NO_ID`` where there is none)."""
    words: np.ndarray
    ends: np.ndarray
    ids: np.ndarray


def write_items(items: DataFrame, folder: str) -> list[int]:
    """Write the items as blocks of about BLOCK_WORDS words, dealt by a hash; the numbers of the blocks."""
    octets = F.octet_length(F.coalesce(F.col("text"), F.lit("")))
    total = items.agg(F.coalesce(F.sum(octets), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // (BLOCK_WORDS * 4)))
    dealt = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int").alias("block"))

    def store(group: pa.Table) -> pa.Table:
        k = group.column("block")[0].as_py()
        hashed, ends, ids, at = [], [], [], 0
        for batch in group.combine_chunks().to_batches():
            for s in wd.word_slices(batch.column("text"), wd.ALNUM):
                hashed.append(s.hashes()[s.codes])
                ends.append(s.ends + at)
                at += len(s.codes)
                own = batch.column("item_id").slice(s.rows.start, s.rows.stop - s.rows.start)
                ids.append(np.asarray(own.cast(pa.int64()).fill_null(NO_ID)))
        for name, parts in (("words", hashed), ("ends", ends), ("ids", ids)):
            ar.save(f"{folder}/items-{k}-{name}.npy", np.concatenate(parts))
        return pa.table({"block": pa.array([k], pa.int32())})

    return sorted(r[0] for r in dealt.groupBy("block").applyInArrow(store, "block int").collect())


def read_items(folder: str, k: int) -> Items:
    return Items(*(ar.load(f"{folder}/items-{k}-{name}.npy") for name in ("words", "ends", "ids")))


class SuffixArray:
    """All suffixes of a shard in the order of their first ``depth`` words.

    ``text`` are the codes of the words, a document's end being -1 less than any
    word and never equal to a test word.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.text = text
        n = len(text)
        rank = text.astype(np.int64) + 1
        order = np.argsort(rank, kind="stable")
        held = rank[order]
        first = np.append(True, held[1:] != held[:-1]) if n else np.zeros(0, bool)
        # The rank of a suffix is the place of its group's first suffix, so a split of one group leaves the others' ranks.
        rank = self._ranks(order, first)
        span = 1
        while span < depth:
            tied = np.flatnonzero(~(first & np.append(first[1:], True))) if n else np.zeros(0, int)
            if not len(tied):
                break
            at = order[tied]
            beyond = np.where(at + span < n, rank[np.minimum(at + span, n - 1)] + 1, 0)
            own = rank[at]
            key = own * np.int64(n + 2) + beyond
            by = np.argsort(key, kind="stable")
            order[tied] = at[by]
            key = key[by]
            first[tied] = np.append(True, key[1:] != key[:-1])
            rank = self._ranks(order, first)
            span *= 2
        self.order = order

    @staticmethod
    def _ranks(order: np.ndarray, first: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        return rank

    def search(self, pattern: np.ndarray, start: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
        """For each test suffix (``length`` codes of ``pattern`` from ``start``) the number of suffixes that are
        before it or, with ``after``, also those that begin with it."""
        n = len(self.order)
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), n, np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._before(self.order[mid], pattern, start[open_], length[open_], after)
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)

    def _before(self, at, pattern, start, length, after):
        out = np.full(len(at), after)
        live = np.arange(len(at))
        n = len(self.text)
        k = 0
        while True:
            live = live[k < length[live]]
            if not len(live):
                return out
            here = at[live] + k
            a = np.where(here < n, self.text[np.minimum(here, n - 1)], -2)
            b = pattern[start[live] + k]
            out[live[a < b]] = True
            out[live[a > b]] = False
            live = live[a == b]
            k += 1


class Shard:
    """The suffix array of a slice of documents and what test items meet in it."""

    def __init__(self, s: wd.Slice, depth: int):
        self.slice = s
        n = len(s.ends)
        hashes = s.hashes()
        self.order = np.argsort(hashes, kind="stable")
        self.known = hashes[self.order]
        # one end mark behind each document
        doc = np.repeat(np.arange(n), s.counts)
        self.text = np.full(len(s.codes) + n, -1, np.int64)
        self.text[np.arange(len(s.codes)) + doc] = s.codes
        self.doc_start = s.starts + np.arange(n)
        self.array = SuffixArray(self.text, depth)

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Codes of test words; a word that the shard doesn't have is above all codes."""
        at, found = ar.position(self.known, words)
        return np.where(found, self.order[at], len(self.known)) if len(self.known) else np.zeros(len(words), np.int64)

    def documents(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_start, places, side="right") - 1

    def matches(self, items: Items, window: int):
        """(item index, test word, words, count, first of the array's run) of every test window that occurs, and all places."""
        ends = np.asarray(items.ends)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        counts = ends - starts
        pattern = self.codes(np.asarray(items.words))
        n = np.where(counts >= window, counts - window + 1, (counts > 0).astype(np.int64))
        item = np.repeat(np.arange(len(ends)), n)
        at = starts[item] + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        words = np.minimum(counts[item], window)
        lo = self.array.search(pattern, at, words, False)
        hi = self.array.search(pattern, at, words, True)
        return item, at, words, lo, hi


def _longest(shard: Shard, items: Items, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, place, item id) of the longest match of each document in the shard: the first of them, and the least id of
    the items that hold it. Without a match there are 0 words.

    In the common order of all suffixes, the longest match of a text's suffix is with the next test suffix before or behind.
    """
    ends = np.asarray(items.ends)
    counts = np.diff(ends, prepend=0)
    item = np.repeat(np.arange(len(ends)), counts)
    # one end mark behind each item
    place_of = np.arange(len(item)) + item
    pattern = np.full(len(item) + len(ends), -1, np.int64)
    pattern[place_of] = shard.codes(np.asarray(items.words))
    item_of = np.repeat(np.arange(len(ends)), counts + 1)
    length_of = (ends + np.arange(len(ends)))[item_of] - np.arange(len(pattern))
    tests = SuffixArray(pattern, depth)
    tests.order = tests.order[length_of[tests.order] > 0]
    n = len(shard.text)
    got = np.zeros(n, np.int64)
    if len(tests.order):
        # How many test suffixes stand before each suffix of the text.
        at = shard.array.search(pattern, tests.order, length_of[tests.order], False)
        before = np.cumsum(np.bincount(at, minlength=n + 1))[:n]
        for near in (np.maximum(before - 1, 0), np.minimum(before, len(tests.order) - 1)):
            start = tests.order[near]
            live, k = np.arange(n), 0
            while len(live):
                here, there = shard.array.order[live] + k, start[live] + k
                # Past its end a test suffix has the mark of its end and a text that of its own, which are no match.
                live = live[(here < n) & (there < len(pattern))]
                here, there = shard.array.order[live] + k, start[live] + k
                live = live[(shard.text[here] == pattern[there]) & (pattern[there] >= 0)]
                k += 1
                reached = shard.array.order[live]
                got[reached] = np.maximum(got[reached], k)
    best = np.maximum.reduceat(got, shard.doc_start) if n else np.zeros(0, np.int64)
    of = np.repeat(best, np.diff(shard.doc_start, append=n))
    places = np.flatnonzero((got == of) & (got > 0))
    docs, first = np.unique(shard.documents(places), return_index=True)
    place, ids = np.full(len(best), -1), np.full(len(best), -1)
    place[docs] = places[first]
    if len(docs):
        runs = np.stack([tests.search(shard.text, place[docs], best[docs], after) for after in (False, True)], axis=1)
        runs, inverse = np.unique(runs, axis=0, return_inverse=True)
        own = np.asarray(items.ids)[item_of[tests.order]]
        least = np.minimum.reduceat(np.append(own, own[-1]), runs.ravel())[::2]
        ids[docs] = least[inverse.ravel()]
    return best, place, ids


def _depth(folder: str, blocks: list[int]) -> int:
    longest = 1
    for k in blocks:
        ends = np.asarray(ar.load(f"{folder}/items-{k}-ends.npy"))
        longest = max(longest, int(np.diff(ends, prepend=0).max(initial=1)))
    return longest


ADDED = ("n_words", "n_hit", "items", "longest_match", "longest_item", "longest_at")


def annotate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (ids of the items with an occurring window) and the
    longest verbatim match of each document: ``longest_match`` words of ``longest_item`` from word ``longest_at``, the first
    of equally long ones and the least id of the items that hold it.

    Item ids are integers. Items without one count like the others: together they are one null in ``items``, behind the ids, and
    ``longest_item`` is null where only they hold the match."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "benchmark")
    blocks = write_items(items, folder)
    docs = docs.drop(*ADDED)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth = None
        for batch in batches:
            for s in wd.word_slices(batch.column("text"), wd.ALNUM, SHARD):
                depth = depth or _depth(folder, blocks)
                shard, n = Shard(s, depth), len(s.ends)
                cover = np.zeros(len(shard.text) + 1, np.int64)
                doc_items: list[set] = [set() for _ in range(n)]
                best, best_item, best_at = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
                for k in blocks:
                    block = read_items(folder, k)
                    ids = np.asarray(block.ids)
                    item, at, words, lo, hi = shard.matches(block, window)
                    for m in np.flatnonzero(hi > lo):
                        places = shard.array.order[lo[m]:hi[m]]
                        np.add.at(cover, places, 1)
                        np.add.at(cover, places + words[m], -1)
                        for d in np.unique(shard.documents(places)):
                            doc_items[d].add(int(ids[item[m]]))
                    got, place, own = _longest(shard, block, depth)
                    place -= shard.doc_start
                    better = (got > 0) & ((got > best) | (got == best) & ((place < best_at) | (place == best_at) & (own < best_item)))
                    best[better], best_item[better], best_at[better] = got[better], own[better], place[better]
                inside = np.cumsum(cover[:-1]) > 0
                inside &= shard.text >= 0
                hits = wd.per_document(inside.astype(np.int64), s.ends + np.arange(1, n + 1))
                part = batch.slice(s.rows.start, s.rows.stop - s.rows.start)
                none = pa.array(best == 0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(s.counts), pa.array(hits),
                     pa.array([[i if i < NO_ID else None for i in sorted(x)] for x in doc_items], pa.list_(pa.int64())), pa.array(best),
                     pa.array(best_item, mask=np.asarray(none) | (best_item == NO_ID)), pa.array(best_at, mask=np.asarray(none))],
                    names=[*part.schema.names, *ADDED])

    return wd.in_batches(docs, SHARD).mapInArrow(run, f"{fields}, n_words long, n_hit long, items array<long>, longest_match long, "
                                "longest_item long, longest_at long")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents without a hit, with the columns of ``docs``."""
    names = docs.columns
    kept = [c for c in names if c in ADDED]
    clear = annotate(docs.withColumnsRenamed({c: f"_own_{c}" for c in kept}), items, window).where("n_hit = 0")
    return clear.select(*[F.col(f"_own_{c}").alias(c) if c in kept else F.col(f"`{c}`") for c in names])
