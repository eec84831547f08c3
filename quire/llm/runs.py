"""Periodic runs of words by recompression.

The texts of a slice (whole documents between separators) are compressed by
turns: a round replaces each maximal block ``a a .. a`` by one symbol for
(a, length), then each pair ``a b`` with a on the left and b on the right side
of a division of the alphabet by one symbol for (a, b). Names are exact (from
dictionaries of pairs, not hashes), and a round depends on symbols only, so
equal stretches are cut alike. Rounds go on until a document is one symbol: a
run-length grammar of logarithmic depth.

A longest common extension of two places walks that grammar: up while both
places start a symbol and the symbols agree, over agreeing symbols (whole
blocks at once), down after the first difference; likewise to the left. All
questions of a slice advance together in numpy.

Candidates come from harmonic grids: for every period p the places a step
apart, step = max(p, least - p), n/1 + n/2 + .. places in all. A run of period
p has p or more consecutive places that agree with the place p further, so a
grid point is among them, and its extensions to both sides give the run whole.
Points whose words differ have none. Runs of a multiple of the smallest period
have the same ends, and the smallest stays. Points inside a run already known
whose period divides p lead to that run again and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import arrays as ar
from . import words as wd

LEAST = 12
SLICE = 4 << 20
CHUNK = 1 << 18  # extensions asked for together
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _coded(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense codes of integers, equal for equal ones only, and how many there are."""
    coded = pa.array(keys).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), len(coded.dictionary)


@dataclass
class Grammar:
    """Symbols of all levels in one row of arrays; level 0 are the words, and symbol 0 is the separator."""
    symbol: np.ndarray
    parent: np.ndarray  # in the next level, or -1
    first: np.ndarray  # first child; at level 0 the place itself
    length: np.ndarray  # words below
    block: np.ndarray  # whether the next level joins blocks (else pairs)
    words: int  # places of level 0

    def _left(self, at: np.ndarray) -> np.ndarray:
        """Symbols before ``at`` in its block."""
        return at - self.first[self.parent[at]]

    def _right(self, at: np.ndarray) -> np.ndarray:
        """Symbols from ``at`` to the end of its block."""
        return self.first[self.parent[at] + 1] - at

    def extend(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words agree from the places a < b of one document on (``back``: to the left)."""
        out = np.zeros(len(a), np.int64)
        query = np.arange(len(a))
        a, b, climbing = a.astype(np.int64), b.astype(np.int64), np.ones(len(a), bool)
        while len(query):
            same = (self.symbol[a] == self.symbol[b]) & (self.symbol[a] > 0)
            x, y, up = a[same], b[same], climbing[same]
            px, py = self.parent[x], self.parent[y]
            if back:
                edge = (self.first[px + 1] - 1 == x) & (self.first[py + 1] - 1 == y)
            else:
                edge = (self.first[px] == x) & (self.first[py] == y)
            up &= (px >= 0) & edge & (self.symbol[px] == self.symbol[py])
            over = ~up
            u, v = x[over], y[over]
            blocks = self.block[u]
            step = np.ones(len(u), np.int64)
            if blocks.any():
                bu, bv = u[blocks], v[blocks]
                step[blocks] = np.minimum(self._left(bu), self._left(bv)) + 1 if back else np.minimum(self._right(bu), self._right(bv))
            out[query[same][over]] += step * self.length[u]
            sign = -1 if back else 1
            x, y = x.copy(), y.copy()
            x[up], y[up] = px[up], py[up]
            x[over], y[over] = u + sign * step, v + sign * step
            down = ~same & (a >= self.words)
            p, q = a[down], b[down]
            if back:
                p, q = self.first[p + 1] - 1, self.first[q + 1] - 1
            else:
                p, q = self.first[p], self.first[q]
            a, b = np.concatenate([x, p]), np.concatenate([y, q])
            climbing = np.concatenate([climbing[same], np.zeros(len(p), bool)])
            query = np.concatenate([query[same], query[down]])
        return out


def compress(text: np.ndarray) -> Grammar:
    """The grammar of symbols > 0 with separators 0 at both ends and between documents, none of which is empty."""
    levels = [text.astype(np.int64)]
    lengths = [np.ones(len(text), np.int64)]
    starts = []  # first child in the level below, for level 1 on
    joins = []  # whether a level's blocks were joined (else pairs)
    fresh = int(text.max(initial=0)) + 1
    documents = int((text == 0).sum()) - 1
    blocks = False
    while len(levels[-1]) > 2 * documents + 1:
        s = levels[-1]
        blocks = not blocks
        if blocks:
            if not ((s[1:] == s[:-1]).any()):
                continue
            head = np.append(True, s[1:] != s[:-1])
            at = np.flatnonzero(head)
            n = np.diff(np.append(at, len(s)))
            new = s[at]
            joined = n > 1
            key = (new[joined] << 32) | n[joined]
        else:
            side = (ar.mix(s, len(levels)) >> np.uint64(17)) & np.uint64(1)
            one = (side[:-1] == 0) & (side[1:] == 1) & (s[:-1] > 0) & (s[1:] > 0)
            other = (side[:-1] == 1) & (side[1:] == 0) & (s[:-1] > 0) & (s[1:] > 0)
            pair = one if one.sum() >= other.sum() else other
            head = np.append(True, ~pair)
            at = np.flatnonzero(head)
            new = s[at]
            joined = np.append(pair, False)[at]
            key = (new[joined] << 32) | s[at[joined] + 1]
        codes, kinds = _coded(key)
        new = new.copy()
        new[joined] = fresh + codes
        fresh += kinds
        lengths.append(np.add.reduceat(lengths[-1], at))
        levels.append(new)
        starts.append(at)
        joins.append(blocks)
    base = np.cumsum([0] + [len(x) for x in levels])
    first = [np.arange(len(text))] + [base[t] + x for t, x in enumerate(starts)]
    parent = []
    for t, x in enumerate(starts):
        head = np.zeros(len(levels[t]), np.int64)
        head[x] = 1
        parent.append(base[t + 1] + np.cumsum(head) - 1)
    parent.append(np.full(len(levels[-1]), -1, np.int64))
    block = np.concatenate([np.full(len(x), j) for x, j in zip(levels, joins + [False])])
    join = lambda parts: np.concatenate(parts).astype(np.int32 if base[-1] < 1 << 31 else np.int64)
    # One entry more, so that the place after the last separator can be asked for.
    return Grammar(join(levels), join(parent), np.append(join(first), base[-2]), join(lengths), block, len(text))


def find(text: np.ndarray, document: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of all runs of ``least`` words or more, in places of ``text``, by start and period.

    ``document``: of each place; separators are in none.
    """
    grammar = compress(text)
    longest = int(np.bincount(document[text > 0]).max(initial=0))
    none = np.zeros(0, np.int64)
    known = (none, none, none)
    period_at, end_at = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    low = 1
    while 2 * low <= longest and longest >= least:
        high = min(2 * low, longest // 2 + 1)
        found = []
        for at, p in _grid(text, document, low, high, least):
            q = period_at[at]
            fresh = (q == 0) | (p % np.maximum(q, 1) != 0) | (at + p >= end_at[at])
            at, p = at[fresh], p[fresh]
            right = grammar.extend(at, at + p)
            left = grammar.extend(at - 1, at + p - 1, back=True)
            whole = left + right >= np.maximum(p, least - p)
            found.append(((at - left)[whole], (at + p + right)[whole], p[whole]))
        start, end, p = (np.concatenate(x) for x in zip(known, *found))
        order = np.lexsort((p, end, start))
        start, end, p = start[order], end[order], p[order]
        new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[:len(start)]
        known = start[new], end[new], p[new]
        for s, e, q in zip(*(x[(known[2] >= low)].tolist() for x in known)):
            period_at[s:e], end_at[s:e] = q, e
        low = high
    start, end, p = known
    order = np.lexsort((p, start))
    return start[order], end[order], p[order]


def _grid(text: np.ndarray, document: np.ndarray, low: int, high: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid points of periods low to high - 1 whose words agree, a bounded number at a time."""
    places, periods, held = [], [], 0
    for p in range(low, high):
        step = max(p, least - p)
        at = np.flatnonzero(text[:-p:step] == text[p::step]) * step
        at = at[(document[at] == document[at + p]) & (text[at] > 0)]
        places.append(at)
        periods.append(np.full(len(at), p, np.int64))
        held += len(at)
        if held >= CHUNK or p + 1 == high:
            at, p = np.concatenate(places), np.concatenate(periods)
            for k in range(0, len(at), CHUNK):
                yield at[k:k + CHUNK], p[k:k + CHUNK]
            places, periods, held = [], [], 0


def _between(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text with separators, document of each place, first place of each document) of documents with words."""
    full = np.flatnonzero(counts)
    n = counts[full]
    first = 1 + np.cumsum(np.append(0, n[:-1] + 1)) if len(n) else np.zeros(0, np.int64)
    text = np.zeros(int(n.sum()) + len(n) + 1, np.int64)
    document = np.zeros(len(text), np.int64)
    where = np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(len(codes)) if len(n) else np.zeros(0, np.int64)
    text[where] = codes + 1
    document[where] = np.repeat(full, n)
    at = np.zeros(len(counts), np.int64)
    at[full] = first
    return text, document, at


def annotate(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    A run is a stretch of words (``[^\\x20\\x09-\\x0D]+``, as they are) with
    smallest period q, at least max(least, 2 q) long, that no neighbouring
    word extends. ``collapsed`` joins by one space the words that no run holds
    after its first q words. Null and empty texts have no words, no runs and an
    empty ``collapsed``. Rows are taken one by one, so ids play no part; columns
    of these three names are replaced. Memory: some arrays of a slice's words, or
    of the longest document's.
    """
    docs = docs.drop("n_words", "runs", "collapsed")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in wd.word_slices(batch.column("text"), wd.AS_IS, SLICE):
                text, document, first = _between(s.codes, s.counts)
                start, end, period = find(text, document, least)
                owner = document[start]
                begin = start - first[owner]
                ends = np.searchsorted(owner, np.arange(len(s.counts) + 1))  # by start, so by document
                runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(x, pa.int64()) for x in (begin, end - start, period)], fields=list(kind.value_type)))
                cover = np.zeros(len(s.codes) + 1, np.int64)
                np.add.at(cover, s.starts[owner] + begin + period, 1)
                np.add.at(cover, s.starts[owner] + begin + end - start, -1)
                keep = np.cumsum(cover[:-1]) == 0
                kept = np.concatenate([[0], np.concatenate([[0], np.cumsum(keep)])[s.ends]])
                lists = pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), s.names.take(pa.array(s.codes[keep])))
                collapsed = pc.binary_join(lists, pa.scalar(" ", s.names.type)).cast(pa.string())
                part = batch.slice(s.rows.start, s.rows.stop - s.rows.start)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s.counts, pa.int64()), runs, collapsed],
                                                 names=[*part.schema.names, "n_words", "runs", "collapsed"])

    return wd.in_batches(docs, SLICE).mapInArrow(scan, f"{fields}, n_words long, runs {RUNS}, collapsed string")
