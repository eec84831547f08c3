import random

import numpy as np
import pytest

from quire.llm import quality, toxicity


@pytest.fixture(scope="module")
def labelled(make, spark):
    rng = random.Random(2)
    words = {"en": "the of and to in stone river house".split(), "de": "der die und von mit stein fluss haus".split()}
    rows, labels = [], []
    for k in range(700):
        lang = rng.choice(list(words))
        text = [rng.choice(words[lang]) + rng.choice(["", "a", "er"]) for _ in range(rng.randint(5, 60))]
        toxic, good = rng.random() < 0.25, rng.random() < 0.7
        if toxic:
            for _ in range(3):
                text.insert(rng.randint(0, len(text)), {"en": "grub", "de": "wurm"}[lang] + rng.choice("abcdefgh"))
        if not good:
            text = [w + "###" for w in text] if rng.random() < 0.5 else text[:2] * 30
        rows.append((k, " ".join(text)))
        if k % 10:
            labels.append((k, int(good), int(toxic)))
    truth = {i: (q, t) for i, q, t in labels}
    frame = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (10**6, 0, 0)], "doc_id long, quality int, toxic int")
    return rows, frame, truth


def test_toxicity_on_held_out_rows(make, labelled):
    rows, labels, truth = labelled
    net = toxicity.fit(make(rows), toxicity.learning_rows(labels))
    import zlib
    got = {r["doc_id"]: r["toxicity"] >= toxicity.AT for r in toxicity.score(make(rows), net).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 150 and np.mean([got[i] == truth[i][1] for i in held]) > 0.93


def test_quality_on_held_out_rows(make, labelled):
    rows, labels, truth = labelled
    model = quality.fit(make(rows), labels.where("doc_id % 3 != 0"))
    got = {r["doc_id"]: r["quality"] >= quality.AT for r in quality.score(make(rows), model).collect()}
    held = [i for i in truth if i % 3 == 0]
    assert np.mean([got[i] == truth[i][0] for i in held]) > 0.95


def test_odd_texts_get_a_score(make, labelled, corpus):
    rows, labels, _ = labelled
    net = toxicity.fit(make(rows), labels, per_class=60)
    got = toxicity.score(make(corpus), net).collect()
    assert len(got) == len(corpus) and all(0 <= r["toxicity"] <= 1 for r in got)
    model = quality.fit(make(rows), labels, per_class=60)
    got = quality.score(make(corpus), model).collect()
    assert len(got) == len(corpus) and all(0 <= r["quality"] <= 1 for r in got)


def test_rejection_keeps_the_columns(make, labelled):
    rows, labels, truth = labelled
    docs = make(rows)
    clash = docs.withColumnRenamed("rows", "toxicity")
    kept = toxicity.reject(clash, labels)
    assert kept.columns == clash.columns
    out = kept.collect()
    assert {r["toxicity"] for r in out} == {7}
    ids = {r["doc_id"] for r in out}
    assert np.mean([i in ids for i, (_, t) in truth.items() if not t]) > 0.95


@pytest.mark.parametrize("labels, value", [([], 0.0), ([(1, 1)], 1.0), ([(1, 0), (2, 0)], 0.0), ([(1, None)], 0.0)])
def test_without_both_labels(spark, make, labels, value):
    frame = spark.createDataFrame([(i, y, y) for i, y in labels], "doc_id long, quality int, toxic int")
    docs = make([(1, "a b"), (2, None), (3, "c")])
    assert {r["toxicity"] for r in toxicity.score(docs, toxicity.fit(docs, frame)).collect()} == {value}
    assert {r["quality"] for r in quality.score(docs, quality.fit(docs, frame)).collect()} == {value}


def test_empty_table(make, labelled):
    _, labels, _ = labelled
    assert toxicity.score(make([]), toxicity.fit(make([]), labels)).count() == 0
    assert quality.score(make([]), quality.fit(make([]), labels)).count() == 0


def test_logits_do_not_depend_on_the_slice():
    rng = np.random.default_rng(0)
    net = toxicity.Network(rows=rng.standard_normal((toxicity.BUCKETS, toxicity.SIZE)).astype(np.float32),
                           kernels=[rng.standard_normal((w, toxicity.SIZE, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
                           out=rng.standard_normal(len(toxicity.WIDTHS) * toxicity.FILTERS).astype(np.float32))
    unit = rng.integers(0, toxicity.BUCKETS, (30, 1 + len(toxicity.PREFIXES)))
    counts = np.array([0, 1, 12, 0, 17])
    codes = np.arange(30)
    whole = net.logits(unit, codes, counts)
    parts = [net.logits(unit, codes[e - n:e], np.array([n]))[0] for n, e in zip(counts, np.cumsum(counts))]
    assert np.allclose(whole, parts, atol=1e-4)


def _f1(logits, y, at):
    said = logits > at
    return 2 * (said & y).sum() / max(1, said.sum() + y.sum())


@pytest.fixture(scope="module")
def many(make, spark):
    """Labels far beyond the sample, with a language that has few of them, and labels that are often wrong."""
    rng = random.Random(9)
    words = {"en": "the of and to in stone river house".split(), "de": "der die und von mit stein fluss haus".split()}
    rows, labels = [], []
    for k in range(4000):
        lang = "de" if rng.random() < 0.08 else "en"
        toxic = rng.random() < 0.4
        text = [rng.choice(words[lang]) for _ in range(rng.randint(5, 30))]
        text += ["grub"] * (toxic if rng.random() < 0.85 else not toxic)
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic), int(toxic)))
    return make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: t for i, t, _ in labels}


def test_toxicity_thresholds_cover_all_labelled_rows(many):
    docs, labels, truth = many
    net = toxicity.fit(docs, labels, per_class=150)
    rows = toxicity.raw(docs, net).collect()
    language, logits = np.array([r["language"] for r in rows]), np.array([r["logit"] for r in rows])
    y = np.array([truth[r["doc_id"]] > 0 for r in rows])
    german = toxicity.LANGUAGES.index("de")
    own = language == german
    assert net.thresholds[german] != net.thresholds[toxicity.LANGUAGES.index("other")]  # that of all languages
    for rows_of, at in ((own, net.thresholds[german]), (language == 0, net.thresholds[0])):
        best = max(_f1(logits[rows_of], y[rows_of], x) for x in logits[rows_of])
        assert _f1(logits[rows_of], y[rows_of], at) > best - 0.02


def test_quality_threshold_covers_all_labelled_rows(many, monkeypatch):
    docs, labels, truth = many
    counted = []
    monkeypatch.setattr(quality, "count", lambda *a: counted.append(toxicity.count(*a)) or counted[0])
    model = quality.fit(docs, labels, per_class=150)
    assert counted[0].rows(0) + counted[0].rows(1) == len(truth) - 240  # all but four fifths of the sample
    rows = quality.raw(docs, model).collect()
    logits, y = np.array([r["logit"] for r in rows]), np.array([truth[r["doc_id"]] > 0 for r in rows])
    assert _f1(logits, y, model.shift) > max(_f1(logits, y, x) for x in logits) - 0.02


def test_threshold_from_counts_is_that_of_the_rows():
    rng = np.random.default_rng(4)
    logits = np.round(rng.normal(0, 6, 500) / toxicity.BIN) * toxicity.BIN + toxicity.BIN / 2  # of a bin all the same
    y = (logits + rng.normal(0, 4, 500) > 1).astype(int)
    share = {0: 3.0, 1: 0.5}
    cells = toxicity.Counts(np.zeros(500, int), np.floor(logits / toxicity.BIN).astype(int), y, np.ones(500, int), logits, logits)
    assert cells.threshold(share) == pytest.approx(toxicity.threshold(logits, y, np.array([share[v] for v in y])))


def test_threshold_splits_at_the_widest_gap():
    assert toxicity.threshold(np.array([5.0, 4.0, -1.0, -2.0]), np.array([1, 1, 0, 0]), np.ones(4)) == pytest.approx(1.5)


def test_features_by_hand():
    text = "AA BB!! c### c\nc 12 |\nc 12 |"
    raw = np.frombuffer(text.encode(), np.uint8)
    f = dict(zip(quality.FEATURES, quality.features(raw, np.array([0, len(raw)]))[0]))
    assert f["log_words"] == pytest.approx(np.log1p(10)) and f["upper_words"] == pytest.approx(0.2)
    assert f["top_word"] == pytest.approx(0.3) and f["distinct_words"] == pytest.approx(0.6)
    assert f["repeated_lines"] == pytest.approx(1 / 3) and f["signed_words"] == pytest.approx(0.2)
    assert f["digits"] == pytest.approx(4 / len(text)) and f["bars"] == pytest.approx(2 / len(text))
