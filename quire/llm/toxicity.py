"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's embedding is the mean of the hashed rows of the word and of its first
letters, so words of one stem share what is learned. Filters of several widths
run over a text's words, the largest response of each filter over the whole
text feeds a logistic unit. It is trained in numpy on a bounded sample of the
labelled rows (``PER_CLASS`` of each label) that tasks have hashed; the labels
that the sample leaves out set the weights of the two classes.

Thresholds are calibrated by language on all labelled rows that training didn't
see: a fifth of the sample and every row outside it. Tasks count them by
language, label and bin of logits, and the thresholds are chosen from the
counts. A language with fewer than ``ENOUGH`` of these rows of either label
takes the threshold of all languages. The language is guessed from the text by
its commonest words, and the score is shifted so that each language's threshold
is ``AT``.

Scoring is one narrow pass: per slice of text, a row of responses for each
distinct word, then sums along the text and a maximum for each document.

Null and empty texts are scored as a text without words. Labels that are null
are no labels; a row labelled twice counts as toxic if any label says so. Rows
that repeat a document are scored each on their own. Without labels of both
kinds every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import words as wd

PER_CLASS = 3000
BUCKETS = 1 << 17
PREFIXES = (3, 4, 5)
WIDTHS = (1, 2, 3)
SIZE = 16
BATCH_WORDS = 1 << 15
SLICE = 3 << 19
FILTERS = 8
AT = 0.7
ENOUGH = 20
BIN, REACH = 1 / 64, 32  # width of a bin of logits; logits beyond +-REACH are in the outermost bins
# Common words of each language, and the languages in the order in which ties are broken.
COMMON = {
    "en": "the of and to in that is was for it with as be by on this are from".split(),
    "de": "der die und den von das mit sich des auf ist ein eine nicht zu dem im".split(),
    "fr": "le la les et des du une est pour que dans au qui sur par pas ne".split(),
    "es": "el los las que y en un por con una su para al lo como del se".split(),
}
LANGUAGES = (*COMMON, "other")


def units(names: pa.Array) -> np.ndarray:
    """Hashed rows (words x units) of distinct words: the word, its first letters."""
    words = names.to_pylist()
    digest = xxhash.xxh64_intdigest
    out = np.empty((len(words), 1 + len(PREFIXES)), np.int64)
    out[:, 0] = [digest(w) % BUCKETS for w in words]
    for k, n in enumerate(PREFIXES, 1):
        out[:, k] = [digest(w[:n], n) % BUCKETS for w in words]
    return out


def votes(names: pa.Array) -> np.ndarray:
    """For each word and language, whether it is one of the language's common words."""
    return np.stack([np.asarray(pc.is_in(names, pa.array(COMMON[c], names.type))) for c in COMMON], axis=1).astype(np.int64)


def guess(counts: np.ndarray) -> np.ndarray:
    """Index in LANGUAGES by the counts of common words (documents x languages)."""
    return np.where(counts.max(1, initial=0) > 0, counts.argmax(1), len(COMMON))


def languages(s: wd.Slice) -> np.ndarray:
    """Index in LANGUAGES of each document of a slice."""
    spoken = votes(s.names)[s.codes]
    return guess(np.stack([np.add.reduceat(np.append(spoken[:, k], 0), s.starts) * (s.counts > 0)
                           for k in range(spoken.shape[1])], axis=1))


def padded(codes: np.ndarray, counts: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes with pads behind each document, so that no window from one of its words reaches the next; where each starts."""
    gap = max(WIDTHS)
    n = len(counts)
    doc = np.repeat(np.arange(n), counts)
    out = np.full(len(codes) + gap * n, pad, np.int64)
    out[np.arange(len(codes)) + gap * doc] = codes
    return out, np.cumsum(counts) - counts + gap * np.arange(n)


@dataclass
class Network:
    rows: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, SIZE), np.float32))
    kernels: list = field(default_factory=list)  # of each width: (width, SIZE, FILTERS)
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    shift: float = 0.0
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))
    constant: float | None = None

    def responses(self, embedded: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
        """Of each width: the filters' values from every place on. ``embedded`` has a zero row for the pad."""
        out = []
        for width, kernel in zip(WIDTHS, self.kernels):
            z = np.zeros((len(codes), FILTERS), np.float32)
            for j in range(width):
                part = embedded @ kernel[j]
                z[:len(codes) - j] += part[codes[j:]]
            out.append(z)
        return out

    def logits(self, unit: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        embedded = np.zeros((len(unit) + 1, SIZE), np.float32)
        for k in range(unit.shape[1]):
            embedded[:-1] += self.rows[unit[:, k]]
        embedded /= unit.shape[1]
        text, starts = padded(codes, counts, len(unit))
        spans = np.stack([starts, starts + np.maximum(counts, 1)], axis=1).ravel()  # each document's own windows
        best = np.concatenate([np.maximum.reduceat(z, spans, axis=0)[::2] for z in self.responses(embedded, text)], axis=1)
        return np.maximum(best + self.bias, 0.0) @ self.out + self.shift

    def scores(self, logits: np.ndarray, language: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(logits), self.constant)
        x = logits.astype(np.float64) - self.thresholds[language] + np.log(AT / (1 - AT))
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def log_odds(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """For each hashed row how much likelier a toxic text holds it, drawn to 0 where few texts hold it."""
    held = {y: np.zeros(BUCKETS) for y in (0, 1)}
    for text, y in zip(texts, labels):
        held[int(y)][np.unique(text)] += 1
    n = {y: max(1, int((labels == y).sum())) for y in (0, 1)}
    odds = np.log((held[1] + 0.5) / (n[1] + 1)) - np.log((held[0] + 0.5) / (n[0] + 1))
    support = held[1] * n[0] / n[1] + held[0]
    return np.where(held[0] + held[1] > 0, odds * support / (support + n[0] / n[1] * 10), 0.0)


def batches(order: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Runs of at most ``most`` texts with at most BATCH_WORDS words, but for a longer text."""
    a = 0
    while a < len(order):
        words = np.cumsum(sizes[order[a:a + most]])
        b = a + max(1, int(np.searchsorted(words, BATCH_WORDS, side="right")))
        yield order[a:b]
        a = b


def train(texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = 8, batch: int = 64,
          rate: float = 0.02, seed: int = 7) -> Network:
    """``texts``: of each document its words' hashed rows (words x units).

    The first number of an embedding starts as the row's log odds and the first filter as a look at it, the rest
    at random.
    """
    rng = np.random.default_rng(seed)
    net = Network(rows=(rng.standard_normal((BUCKETS, SIZE)) * 0.05).astype(np.float32),
                  kernels=[(rng.standard_normal((w, SIZE, FILTERS)) / np.sqrt(w * SIZE)).astype(np.float32) for w in WIDTHS],
                  out=(rng.standard_normal(len(WIDTHS) * FILTERS) * 0.1).astype(np.float32))
    net.rows[:, 0] = log_odds(texts, labels)
    net.kernels[0][:, :, 0] = 0
    net.kernels[0][0, 0, 0] = net.out[0] = 1
    net.shift = -1.0
    squares = np.full(BUCKETS, 1e-6, np.float32)
    dense = [net.bias, net.out, *net.kernels]
    dense_squares = [np.full(p.shape, 1e-6, np.float32) for p in dense]
    shift_square = 1e-6
    n_units = 1 + len(PREFIXES)
    sizes = np.array([len(t) for t in texts])
    for _ in range(epochs):
        for pick in batches(rng.permutation(len(texts)), sizes, batch):
            counts = np.array([len(texts[i]) for i in pick])
            unit = np.concatenate([texts[i] for i in pick])
            embedded = np.zeros((len(unit) + 1, SIZE), np.float32)
            for k in range(n_units):
                embedded[:-1] += net.rows[unit[:, k]]
            embedded /= n_units
            codes, starts = padded(np.arange(len(unit)), counts, len(unit))
            stops = starts + np.maximum(counts, 1)
            places, best = [], []
            for z in net.responses(embedded, codes):
                at = np.stack([a + z[a:e].argmax(0) for a, e in zip(starts, stops)])
                places.append(at)
                best.append(np.take_along_axis(z, at, 0))
            h = np.concatenate(best, axis=1) + net.bias
            active = np.maximum(h, 0.0)
            p = 1 / (1 + np.exp(-np.clip(active @ net.out + net.shift, -30, 30)))
            slope = ((p - labels[pick]) * weights[pick] / len(pick)).astype(np.float32)
            back = slope[:, None] * net.out * (h > 0)
            grads = [back.sum(0), active.T @ slope]
            row_ids, row_grads = [], []
            for k, (width, kernel) in enumerate(zip(WIDTHS, net.kernels)):
                own = back[:, k * FILTERS:(k + 1) * FILTERS]
                grad = np.empty_like(kernel)
                for j in range(width):
                    here = codes[np.minimum(places[k] + j, len(codes) - 1)]
                    grad[j] = np.einsum("bf,bfd->df", own, embedded[here])
                    real = here < len(unit)
                    change = (own[:, :, None] * kernel[j].T[None]) * (1.0 / n_units)
                    for u in range(n_units):
                        row_ids.append(unit[np.minimum(here, len(unit) - 1), u][real])
                        row_grads.append(change[real])
                grads.append(grad)
            ids, inverse = np.unique(np.concatenate(row_ids), return_inverse=True) if len(unit) else (np.zeros(0, int), None)
            if len(ids):
                total = np.zeros((len(ids), SIZE), np.float32)
                np.add.at(total, inverse, np.concatenate(row_grads))
                squares[ids] += (total ** 2).mean(1)
                net.rows[ids] -= rate * total / np.sqrt(squares[ids])[:, None]
            for p_, g, s in zip(dense, grads, dense_squares):
                s += g ** 2
                p_ -= rate * g / np.sqrt(s)
            shift_square += float(slope.sum()) ** 2
            net.shift -= rate * float(slope.sum()) / np.sqrt(shift_square)
    return net


def cut(low: np.ndarray, high: np.ndarray, hit: np.ndarray, miss: np.ndarray) -> float:
    """The middle of the widest step of logits with the best F1. Of each bin, from the highest down: its least and
    greatest logit, the weights of its toxic rows and of the others."""
    hits, misses = np.cumsum(hit), np.cumsum(miss)
    f1 = 2 * hits / np.maximum(hits + misses + hit.sum(), 1e-9)
    below = np.append(high[1:], low[-1] - 2.0)
    f1 = np.where(low > below, f1, -1.0)
    good = np.flatnonzero(f1 >= f1.max() - 1e-9)
    k = good[np.argmax((low - below)[good])]
    return float((low[k] + below[k]) / 2)


def threshold(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The middle of the widest step of logits with the best F1."""
    order = np.argsort(-logits, kind="stable")
    x, y, w = logits[order], labels[order] > 0, weights[order]
    return cut(x, x, w * y, w * ~y)


@dataclass
class Counts:
    """Labelled rows by language, bin of logits and label: how many, their least and greatest logit."""
    language: np.ndarray
    bin: np.ndarray
    y: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def of(self, rows: np.ndarray) -> Counts:
        return Counts(*(getattr(self, f)[rows] for f in ("language", "bin", "y", "n", "low", "high")))

    def rows(self, y: int) -> int:
        return int(self.n[self.y == y].sum())

    def threshold(self, share: dict[int, float]) -> float:
        """The cut between two bins with the best F1, a row of label y weighing ``share[y]``."""
        bins, at = np.unique(-self.bin, return_inverse=True)  # the highest first
        low, high = np.full(len(bins), np.inf), np.full(len(bins), -np.inf)
        np.minimum.at(low, at, self.low)
        np.maximum.at(high, at, self.high)
        hit, miss = (np.bincount(at, self.n * (self.y == y) * share[y], len(bins)) for y in (1, 0))
        return cut(low, high, hit, miss)


def count(logits: DataFrame, named: DataFrame, seen: list) -> Counts:
    """The labelled rows (``named``: doc_id, y) among all of ``logits`` (doc_id, language, logit) without those whose id
    is among ``seen``; with them if one of the labels is only there."""
    known = logits.sparkSession.createDataFrame([(i,) for i in seen], StructType([logits.schema["doc_id"]])).distinct()
    place = F.floor(F.greatest(F.least("logit", F.lit(float(REACH))), F.lit(-float(REACH))) / BIN).cast("int")
    cells = (logits.join(named.where("y in (0, 1)"), "doc_id")
             .join(F.broadcast(known.withColumn("seen", F.lit(True))), "doc_id", "left")  # at most the rows of the sample
             .groupBy("language", place.alias("bin"), "y", F.coalesce("seen", F.lit(False)).alias("seen"))
             .agg(F.count(F.lit(1)).alias("n"), F.min("logit").alias("low"), F.max("logit").alias("high")).collect())
    new = [r for r in cells if not r["seen"]]
    cells = new if len({r["y"] for r in new}) == 2 else cells
    return Counts(*(np.array([r[f] for r in cells]) for f in ("language", "bin", "y", "n", "low", "high")))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Network:
    """A network of at most ``per_class`` rows of each label, drawn by a hash of the id; its thresholds are of all rows."""
    named = (labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    size = {int(r["y"]): int(r["count"]) for r in named.groupBy("y").count().collect() if r["y"] in (0, 1)}
    total = sum(size.values())
    if not size.get(0) or not size.get(1):
        return Network(constant=size.get(1, 0) / total if total else 0.0)
    drawn = [named.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in wd.word_slices(batch.column("text"), wd.ALNUM, 1 << 20):
                rows = units(s.names).astype(np.int32)[s.codes]
                part = batch.slice(s.rows.start, s.rows.stop - s.rows.start)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("y"),
                     pa.array([rows[a:e].tobytes() for a, e in zip(s.starts, s.ends)], pa.binary())],
                    names=["doc_id", "y", "units"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn[0].union(drawn[1])), "doc_id")  # at most 2 * per_class rows
    rows = wd.in_batches(sample, SLICE).mapInArrow(hashed, f"doc_id {kind}, y int, units binary").withColumn(
        "place", F.xxhash64("doc_id")).collect()
    rows.sort(key=lambda r: (r["place"], r["units"]))
    texts = [np.frombuffer(r["units"], np.int32).reshape(-1, 1 + len(PREFIXES)) for r in rows]
    y = np.array([r["y"] for r in rows], np.float32)
    if not len(rows) or y.min() == y.max():
        return Network(constant=size[1] / total)
    held = np.zeros(len(rows), bool)
    held[::5] = True
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    balance = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y == 0).mean())
    fit_on = np.flatnonzero(~held)
    net = train([texts[i] for i in fit_on], y[fit_on], balance[fit_on])
    cells = count(raw(docs, net), named, [rows[i]["doc_id"] for i in fit_on])
    # Of the whole set of labels; the network itself is trained on classes of equal weight.
    share = {v: size[v] / max(1, cells.rows(v)) for v in (0, 1)}
    overall = cells.threshold(share)
    for k in range(len(LANGUAGES)):
        own = cells.of(cells.language == k)
        net.thresholds[k] = own.threshold(share) if min(own.rows(0), own.rows(1)) >= ENOUGH else overall
    return net


def raw(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id``, ``language`` (its index) and ``logit`` of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shipped.value
        for batch in batches:
            for s in wd.word_slices(batch.column("text"), wd.ALNUM, SLICE):
                ids = batch.column("doc_id").slice(s.rows.start, s.rows.stop - s.rows.start)
                logits = net.logits(units(s.names), s.codes, s.counts).astype(np.float64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(languages(s), pa.int32()), pa.array(logits)],
                                                 names=["doc_id", "language", "logit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return wd.in_batches(docs.select("doc_id", "text"), SLICE).mapInArrow(run, f"doc_id {kind}, language int, logit double")


def score(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with ``toxicity`` between 0 and 1 (a column of that name is replaced)."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)
    docs = docs.drop("toxicity")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shipped.value
        for batch in batches:
            for s in wd.word_slices(batch.column("text"), wd.ALNUM, SLICE):
                n = len(s.ends)
                if net.constant is not None:
                    value = np.full(n, net.constant)
                else:
                    value = net.scores(net.logits(units(s.names), s.codes, s.counts), languages(s))
                part = batch.slice(s.rows.start, s.rows.stop - s.rows.start)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value)], names=[*part.schema.names, "toxicity"])

    return wd.in_batches(docs, SLICE).mapInArrow(run, f"{fields}, toxicity double")


def learning_rows(labels: DataFrame) -> DataFrame:
    """Labels whose crc32 of the id as text leaves 0 or 2 when divided by three."""
    return labels.where(crc_fold(3) != 1)


def crc_fold(of: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of, F.lit(0))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't find toxic, with the columns of ``docs``."""
    net = fit(docs, learning_rows(labels))
    own = "toxicity" in docs.columns
    scored = score(docs.withColumnRenamed("toxicity", "_own_toxicity"), net).where(F.col("toxicity") < AT).drop("toxicity")
    return (scored.withColumnRenamed("_own_toxicity", "toxicity") if own else scored).select(*[f"`{c}`" for c in docs.columns])
