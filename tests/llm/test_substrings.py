import hashlib

import numpy as np
import pytest

from quire.llm import substrings
from quire.llm.queries import q_substrings


def expected(rows, size):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    first = {}
    for k in order:
        w = (rows[k][1] or "").encode().split()
        key = (rows[k][0] is None, rows[k][0])
        for s in range(len(w) - size + 1):
            at = (key, s)
            win = tuple(w[s:s + size])
            first[win] = min(first.get(win, at), at)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if first[tuple(w[s:s + size])] < ((i is None, i), s):
                gone[s:s + size] = [True] * size
        out.append((i, len(w), sum(gone), b" ".join(a for a, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1, 3, 20])
def test_matches_brute_force(make, corpus, size):
    got = substrings.deduplicate(make(corpus), size=size)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got.collect()), key=str) == expected(corpus, size)
    assert got.columns == [c for c in make(corpus).columns if c != "n_words"] + ["n_words", "n_removed"]


def test_text_without_repeats_can_stay_as_it_is(make):
    text = "a  b\n c"
    assert substrings.deduplicate(make([(1, text)]), rejoin=False).first()["text"] == text


def test_empty_table(make):
    assert substrings.deduplicate(make([])).count() == 0


def test_gaps_come_back():
    at = np.array([0, 0, 5, 65535, 65536, 200000, 16777215])
    assert substrings.places(substrings.gaps(at)).tolist() == at.tolist()


def test_rolling_hash_depends_on_order_and_every_word():
    a = np.arange(40, dtype=np.uint64)
    h = substrings.window_hashes(a, 20, 0)
    assert len(h) == 21
    for k in range(20):
        b = a.copy()
        b[k] += 99
        assert substrings.window_hashes(b, 20, 0)[0] != h[0]
    assert substrings.window_hashes(a[::-1].copy(), 20, 0)[20] != h[0]
    assert substrings.window_hashes(a[5:25], 20, 1)[0] == substrings.window_hashes(a, 20, 1)[5]


def test_no_window_is_missed_by_a_tiny_sketch(make, spark, corpus, monkeypatch):
    """A sketch that takes nearly all windows for repeated costs time, not results."""
    real = substrings.build_sketch
    monkeypatch.setattr(substrings, "build_sketch", lambda docs, size, width, folder: real(docs, size, 256, folder))
    got = substrings.deduplicate(make(corpus), size=20)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got.collect()), key=str) == expected(corpus, 20)


def test_query_digests_the_kept_text(spark, make, corpus, tmp_path):
    make(corpus, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in q_substrings(spark, str(tmp_path)).collect()}
    assert got == {(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in expected(corpus, 20)}
