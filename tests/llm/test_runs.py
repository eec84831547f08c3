import hashlib
import random
import zlib

import numpy as np
import pytest

from quire.llm import runs
from quire.llm.queries import q_runs


def brute(words, least=12):
    """(start, length, period) by agreement of neighbours, and the kept words."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1) if j == i else j
    out = sorted((s, e - s, p) for (s, e), p in found.items())
    gone = {i for s, n_, p in out for i in range(s + p, s + n_)}
    return out, [w for i, w in enumerate(words) if i not in gone]


def texts():
    rng = random.Random(3)
    few = lambda k, n: [rng.choice("abcdefgh"[:k]) for _ in range(n)]
    out = [few(k, n) for k in (1, 2, 3, 8) for n in (1, 5, 11, 12, 13, 40, 200)]
    for p in (1, 2, 3, 5, 7, 12, 31):
        for tail in (0, 1, p // 2):
            out.append(few(8, 9) + (few(8, p) * 5) + few(8, tail) + few(3, 6))
    fib = ["a"], ["a", "b"]
    for _ in range(11):
        fib = fib[1], fib[1] + fib[0]
    out += [fib[1], (few(3, 6) * 3 + few(2, 2)) * 4, few(2, 6) * 2, few(2, 6) * 2 + ["z"]]
    out.append([f"w{rng.randint(0, 900)}" for _ in range(900)] + ["x", "y", "z"] * 400)
    return out


def test_matches_brute_force(make):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts())] + [(500, None), (501, ""), (502, " \n"), (503, "a\tb \n" * 9), (503, "a\tb \n" * 9), (None, "q " * 12)]
    got = runs.annotate(make(rows))
    assert got.columns[-3:] == ["n_words", "runs", "collapsed"] and got.columns.count("n_words") == 1
    seen = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()]
    want = []
    for i, t in rows:
        words = (t or "").split()
        found, kept = brute(words)
        want.append((i, len(words), found, " ".join(kept)))
    for s, w in zip(sorted(seen, key=str), sorted(want, key=str), strict=True):
        assert s == w


@pytest.mark.parametrize("least", [2, 5, 12])
def test_shorter_runs(make, least):
    words = "a a b a b a a b a b b b c c d e d e d".split()
    got = runs.annotate(make([(1, " ".join(words))]), least=least).first()
    assert [tuple(x) for x in got["runs"]] == brute(words, least)[0]


def test_extensions_match_plain_ones():
    rng = np.random.default_rng(2)
    parts = [rng.integers(1, 3, 300), np.tile(rng.integers(1, 4, 17), 40), np.full(257, 5), rng.integers(1, 900, 400)]
    text = np.concatenate([[0]] + [np.append(p, 0) for p in parts])
    grammar = runs.compress(text)
    ends = np.flatnonzero(text == 0)
    a, b = [], []
    for s, e in zip(ends, ends[1:]):
        x = rng.integers(s + 1, e, (400, 2))
        x = x[x[:, 0] != x[:, 1]]
        a += x.min(1).tolist()
        b += x.max(1).tolist()
    right, left = grammar.extend(np.array(a), np.array(b)), grammar.extend(np.array(a), np.array(b), back=True)
    for i, j, r, l in zip(a, b, right, left):
        n = 0
        while text[j + n] and text[i + n] == text[j + n]:
            n += 1
        m = 0
        while text[i - m] and text[i - m] == text[j - m]:
            m += 1
        assert (r, l) == (n, m)


def test_grammar_is_shallow_for_long_runs():
    text = np.concatenate([[0], np.full(100_000, 7), [0]])
    assert len(runs.compress(text).symbol) < len(text) + 10
    period = np.concatenate([[0], np.tile(np.arange(1, 52), 4000), [0]])
    grammar = runs.compress(period)
    assert len(grammar.symbol) < 6 * len(period)


def test_query_matches_brute_force(spark, make, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnop") + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 120)))) for i in range(120)]
    rows += [(700, "x y " * 30), (None, "x y " * 30), (701, None)]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in q_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    rewritten = 0
    for i, t in rows:
        words = (t or "").split()
        n = len(words)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a, rewritten = g % n, rewritten + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        found, kept = brute(words)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = got[i]
        assert (r["n_runs"], r["runs_sha256"], r["collapsed_sha256"]) == (len(found), sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(kept)))
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert rewritten > 5


def test_empty_table(make):
    assert runs.annotate(make([])).count() == 0
