"""Quality by a generalised additive model with pairwise interactions.

Each text becomes a row of numbers (``FEATURES``). Boosting goes round the
features in cycles: a shallow tree over one feature's bins takes a step down
the loss, and its leaves are added to that feature's lookup table. The pairs
of features whose tables explain most of what is left are boosted the same way
with trees over two features' bins. A score is a sum of table cells.

It is trained in numpy on the features of a bounded sample of labelled rows
(``PER_CLASS`` of each label). The threshold is chosen from counts by bin of
logits of all labelled rows that training didn't see. The tables are a few
kilobytes; scoring is one narrow pass over the texts, vectorised over a slice of
documents.

Null and empty texts are rows of zeros and get a score like any other. Labels
that are null are no labels; a row labelled twice counts as good only if all
labels say so. Rows that repeat a document are scored each on their own.
Without labels of both kinds every score is the share of good labels (0
without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as wd
from .toxicity import COMMON, count

PER_CLASS = 20000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
AT = 0.3
FEATURES = ("log_words", "word_bytes", "word_bytes_spread", "upper_words", "digits", "signs", "shouts", "bars",
            "lines_per_word", "other_bytes", "distinct_words", "top_word", "repeated_lines", "signed_words",
            "common_words", "stops_per_word")
# Classes of bytes: digits, signs, exclamation and question marks, bars, line ends, sentence ends, not ASCII.
_DIGIT, _SIGN, _SHOUT, _BAR, _LINE, _STOP, _OTHER = range(1, 8)
_KIND = np.zeros(256, np.uint8)
_KIND[48:58] = _DIGIT
_KIND[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126]] = _SIGN
_KIND[[33, 63]] = _SHOUT
_KIND[124] = _BAR
_KIND[10] = _LINE
_KIND[46] = _STOP
_KIND[128:] = _OTHER
_COMMON = pa.array(sorted({w for ws in COMMON.values() for w in ws}), pa.large_string())


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[np.concatenate([[0], ends])]).astype(np.float64)


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    kind = _KIND[raw]
    byte = {k: _sums(kind == k, offsets[1:]) for k in (_DIGIT, _SIGN, _SHOUT, _BAR, _LINE, _STOP, _OTHER)}
    words, ends = wd.split(raw, offsets, wd.AS_IS)
    coded = words.dictionary_encode()
    codes, names = np.asarray(coded.indices).astype(np.int64), coded.dictionary
    count = np.diff(np.concatenate([[0], ends])).astype(np.float64)
    per = np.maximum(count, 1)
    long = np.asarray(pc.binary_length(names)).astype(np.int64)
    data, off = wd.text_bytes(names)
    last = _KIND[data[off[1:] - 1]] if len(names) else np.zeros(0, np.uint8)
    upper = np.asarray(pc.and_(pc.utf8_is_upper(names), pc.greater(pc.utf8_length(names), 1))).astype(np.int64)
    common = np.asarray(pc.is_in(pc.ascii_lower(names), _COMMON)).astype(np.int64)
    total_long, total_square = _sums(long[codes], ends), _sums(long[codes] ** 2, ends)
    doc = np.repeat(np.arange(n), count.astype(np.int64))
    key, times = np.unique(doc * max(1, len(names)) + codes, return_counts=True)
    own = key // max(1, len(names))
    distinct = np.bincount(own, minlength=n).astype(np.float64)
    top = np.zeros(n)
    np.maximum.at(top, own, times)
    lines, line_ends = _lines(raw, offsets)
    line_count = np.diff(np.concatenate([[0], line_ends]))
    line_doc = np.repeat(np.arange(n), line_count)
    line_codes = np.asarray(lines.dictionary_encode().indices).astype(np.int64)
    kept = np.bincount(np.unique(line_doc * max(1, len(line_codes)) + line_codes) // max(1, len(line_codes)), minlength=n)
    mean = total_long / per
    return np.stack([
        np.log1p(count), mean, np.sqrt(np.maximum(total_square / per - mean ** 2, 0.0)), _sums(upper[codes], ends) / per,
        byte[_DIGIT] / size, byte[_SIGN] / size, byte[_SHOUT] / size, byte[_BAR] / size, byte[_LINE] / per,
        byte[_OTHER] / size, distinct / per, top / per, 1 - kept / np.maximum(line_count, 1),
        _sums(((last == _SIGN) | (last == _SHOUT))[codes], ends) / per, _sums(common[codes], ends) / per, byte[_STOP] / per,
    ], axis=1)


def _lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)),
                                             pa.py_buffer(np.ascontiguousarray(raw)))
    parts = pc.split_pattern(texts, "\n")
    return parts.values, np.asarray(parts.offsets)[1:].astype(np.int64)


@dataclass
class Additive:
    """Lookup tables of features and of pairs of features."""
    start: float = 0.0
    edges: list = field(default_factory=list)  # of each feature
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)  # (first feature, second feature, table)
    coarse: list = field(default_factory=list)  # edges of the pairs' bins
    shift: float = 0.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for i, j, table in self.pairs:
            out += table[np.searchsorted(self.coarse[i], x[:, i], side="right"),
                         np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self.logits(x) - self.shift + np.log(AT / (1 - AT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g ** 2 / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Steps of a shallow tree over a row of bins with gradients ``g`` and curvatures ``h``."""
    gs, hs = np.cumsum(g), np.cumsum(h)
    if depth and len(g) > 1:
        gain = _gain(gs[:-1], hs[:-1]) + _gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1]) - _gain(gs[-1], hs[-1])
        k = int(np.argmax(gain))
        if gain[k] > 1e-9:
            return np.concatenate([_tree(g[:k + 1], h[:k + 1], depth - 1), _tree(g[k + 1:], h[k + 1:], depth - 1)])
    return np.full(len(g), -gs[-1] / (hs[-1] + 1.0))


def _tree2(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Steps of a tree over a grid of bins: the best split of one axis, then one split of the other on each side."""
    best, out = -np.inf, None
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for k in range(len(a) - 1):
            step = np.empty_like(a)
            gain = 0.0
            for side in (slice(0, k + 1), slice(k + 1, None)):
                own_g, own_h = a[side].sum(0), b[side].sum(0)
                row = _tree(own_g, own_h, 1)
                gain += float((-row * own_g - 0.5 * row ** 2 * own_h).sum())
                step[side] = row
            if gain > best:
                best, out = gain, (step.T if turn else step)
    return out


def train(x: np.ndarray, y: np.ndarray, weights: np.ndarray, cycles: int = 40, pair_cycles: int = 15, rate: float = 0.2) -> Additive:
    p0 = float((weights * y).sum() / weights.sum())
    model = Additive(start=float(np.log(p0 / (1 - p0))))
    levels = np.linspace(0, 1, BINS + 1)[1:-1]
    rough = np.linspace(0, 1, PAIR_BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, j], levels)) for j in range(x.shape[1])]
    model.coarse = [np.unique(np.quantile(x[:, j], rough)) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    z = np.full(len(x), model.start)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return weights * (p - y), weights * p * (1 - p)

    for _ in range(cycles):
        for j, own in enumerate(bins):
            g, h = slopes()
            step = rate * _tree(np.bincount(own, g, len(model.tables[j])), np.bincount(own, h, len(model.tables[j])), 2)
            model.tables[j] += step
            z += step[own]
    grid = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]

    def cells(i, j, v):
        a, b = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        return np.bincount(grid[i] * b + grid[j], v, a * b).reshape(a, b)

    g, h = slopes()
    found = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            a, b = cells(i, j, g), cells(i, j, h)
            step = _tree2(a, b) if min(a.shape) > 1 else None
            if step is not None:
                found.append((float((-step * a - 0.5 * step ** 2 * b).sum()), i, j))
    model.pairs = [(i, j, np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)))
                   for _, i, j in sorted(found, reverse=True)[:PAIRS]]
    for _ in range(pair_cycles):
        for i, j, table in model.pairs:
            g, h = slopes()
            step = rate * _tree2(cells(i, j, g), cells(i, j, h))
            table += step
            z += step[grid[i], grid[j]]
    return model


def measured(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``extra`` columns and the ``features`` of each row."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    keep = ("doc_id", *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in wd.slices(batch.column("text"), 4 << 20):
                x = features(raw, off)
                part = batch.slice(rows.start, rows.stop - rows.start)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], lists], names=[*keep, "features"])

    return wd.in_batches(docs.select(*keep, "text")).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", features array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Additive:
    """A model of at most ``per_class`` rows of each label, drawn by a hash of the id; its threshold is of all rows."""
    named = (labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
             .groupBy("doc_id").agg(F.min("y").alias("y")))
    size = {int(r["y"]): int(r["count"]) for r in named.groupBy("y").count().collect() if r["y"] in (0, 1)}
    total = sum(size.values())
    if not size.get(0) or not size.get(1):
        return Additive(constant=size.get(1, 0) / total if total else 0.0)
    drawn = [named.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn[0].union(drawn[1])), "doc_id")  # at most 2 * per_class rows
    rows = measured(sample, ("y",)).withColumn("place", F.xxhash64("doc_id")).collect()
    rows.sort(key=lambda r: (r["place"], r["features"]))
    y = np.array([r["y"] for r in rows], np.float64)
    if not len(rows) or y.min() == y.max():
        return Additive(constant=size[1] / total)
    x = np.array([r["features"] for r in rows])
    share = np.array([size[int(v)] / max(1, (y == v).sum()) for v in y])
    share /= share.mean()
    held = np.zeros(len(rows), bool)
    held[::5] = True
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    model = train(x[~held], y[~held], share[~held])
    cells = count(raw(docs, model), named, [r["doc_id"] for r, out in zip(rows, held) if not out])
    model.shift = cells.threshold({v: size[v] / max(1, cells.rows(v)) for v in (0, 1)})
    return model


def raw(docs: DataFrame, model: Additive) -> DataFrame:
    """``doc_id``, ``language`` (0: all have one threshold) and ``logit`` of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in wd.slices(batch.column("text"), 4 << 20):
                ids = batch.column("doc_id").slice(rows.start, rows.stop - rows.start)
                logits = shipped.value.logits(features(data, off))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.zeros(len(ids), np.int32)), pa.array(logits)],
                                                 names=["doc_id", "language", "logit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return wd.in_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, language int, logit double")


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """``doc_id`` and ``quality`` between 0 and 1 of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in wd.slices(batch.column("text"), 4 << 20):
                ids = batch.column("doc_id").slice(rows.start, rows.stop - rows.start)
                value = shipped.value.scores(features(raw, off))
                yield pa.RecordBatch.from_arrays([ids, pa.array(value)], names=["doc_id", "quality"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return wd.in_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, quality double")
