import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import licenses

EXTRA = [
    (201, "All rights reserved. ALL RIGHTS, reserved"), (202, "cc by cc-by CC BY cc by"),
    (203, "This work is licensed under the GNU General Public License, version 3."),
    (204, "x Licensed under CC BY-NC 4.0. y"), (205, "Released under the MIT License."), (206, "the license of mit"),
    (207, "Permission is hereby granted, free of charge, to any person obtaining a copy of that software"),
    (208, "apache license"), (209, "Licensed under the Apache License, Version 2.0."), (210, "general public licenses"),
    (211, "reserved rights all"), (212, "general PUBLIC license " * 3000), (213, "İll rights reserved all rİghts reserved"),
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_base_matches_brute_force(make, corpus):
    rows = corpus + EXTRA
    want = []
    for i, t in rows:
        w = words(t)
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    got = [tuple(r)[:6] for r in licenses.scan(make(rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def direct(rows, templates):
    """Labels and score of every row, trying every template at every start."""
    texts = [words(t) for _, t in rows]
    out = {}
    vocabulary = {w for t in templates for w in t.text.split()}
    df = {w: sum(w in set(x) for x in texts) for w in vocabulary}
    for (i, _), w in zip(rows, texts):
        spaced = " " + " ".join(w) + " "
        labels, best = {v for p, v in licenses.PHRASES.items() if f" {p} " in spaced}, 0.0
        best = 0.5 if labels else 0.0
        for t in templates:
            own = t.text.split()
            rare = sorted(set(own), key=lambda x: (df[x], own.index(x)))[:licenses.RARE]
            idf = {x: math.log((len(rows) + 1) / (df[x] + 0.5)) for x in rare}
            for a in range(-len(own), len(w)):
                at = lambda k: w[a + k] if 0 <= a + k < len(w) else None
                share = sum(idf[x] for x in rare if at(own.index(x)) == x) / sum(idf.values())
                if share >= licenses.NEEDED and all(
                        [at(k) for k in range(s, s + len(p))] == p for p in map(str.split, t.phrases)
                        for s in [next(k for k in range(len(own)) if own[k:k + len(p)] == p)]):
                    labels.add(t.label)
                    best = max(best, share)
        out[i] = (",".join(sorted(labels)), pytest.approx(min(best, 1.0)))
    return out


def test_labels_and_score_match_brute_force(make, corpus):
    """Texts cut off at either end, with a word changed, moved by a word, two templates in one file, one twice."""
    rng = random.Random(2)
    rows = [r for r in corpus if r[0] not in (None, 63, 64, 70)] + [r for r in EXTRA if r[0] != 212]
    for k, t in enumerate(licenses.TEMPLATES):
        w = t.text.split()
        rows += [(1000 + k, t.text.upper()), (1100 + k, "a " * k + t.text + ", " + licenses.TEMPLATES[k - 1].text + " z " + t.text)]
        rows += [(1200 + 10 * k + j, " ".join(v)) for j, v in enumerate(
            (w[1:], w[:-1], ["x"] + w[:2] + ["y"] + w[2:], [x if rng.random() < 0.85 else "y" for x in w]))]
    want = direct(rows, licenses.TEMPLATES)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(make(rows)).collect()}
    assert got == want and len({v[0] for v in got.values()}) > 20


def test_other_templates_and_clashing_columns(make, corpus):
    rows = make([(1, "alpha beta gamma"), (1, "alpha beta gamma"), (2, None), (3, "gamma beta alpha")]).withColumn(
        "labels", F.lit("own")).withColumn("score", F.lit("x")).withColumn("_found", F.lit(1))
    same = tuple(licenses.Template(n, "alpha beta gamma", ("beta",)) for n in ("one", "two"))
    got = sorted((r["doc_id"], r["labels"]) for r in licenses.scan(rows, same, licenses.PHRASES).collect())
    assert got == [(1, "one,two"), (1, "one,two"), (2, ""), (3, "")]
    assert {r["labels"] for r in licenses.scan(rows, (), licenses.PHRASES).collect()} == {""}


def test_hundreds_of_templates(make):
    """One index: the plan's size doesn't follow the number of templates with nested passes."""
    text = lambda k: " ".join(f"w{(k * 7 + j * 13) % 400}" for j in range(30))
    many = tuple(licenses.Template(f"t{k:03}", text(k), (" ".join(text(k).split()[3:7]),)) for k in range(300))
    rows = make([(k, "x y " + text(k) + " z") for k in range(0, 300, 7)] + [(999, "nothing here")])
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(rows, many).collect()}
    assert all(f"t{k:03}" in v.split(",") for k, v in got.items() if k != 999) and got[999] == ""


def test_labels_of_the_method(make):
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(make(EXTRA)).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        201: "reserved", 202: "cc-by", 203: "gpl,gpl-3.0", 204: "cc-by,cc-by-nc", 205: "mit", 206: "", 207: "mit", 208: "",
        209: "apache-2.0", 210: "", 211: "", 212: "gpl", 213: ""}
    assert all(0 <= s <= 1 for _, s in got.values()) and got[203][1] == 1.0 and got[206][1] == 0.0


def test_empty_table(make):
    assert licenses.scan(make([])).count() == 0


def test_no_python_in_the_plan(make, corpus):
    plan = licenses.scan(make(corpus))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
