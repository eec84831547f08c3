import hashlib
import random
import zlib

import numpy as np
import pytest

from quire.llm import trie
from quire.llm.queries import q_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, p1 string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "own") for r in rows], SCHEMA)


def brute(convs):
    """Rows of the trie from {conv_id: [(role, text)]}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = {k: [] for k in members}
    for k in members:
        for d in range(len(k) + 1):
            below[k[:d]].append(k)
    children = {k: 0 for k in members}
    for k in members:
        if k:
            children[k[:-1]] += 1
    out = []
    for k, who in members.items():
        ends = sorted(c for c in who if len(convs[c]) == len(k))
        out.append((min(who), len(k), min(members[k[:-1]]) if k else None, len(who), children[k], sum(children[b] == 0 for b in below[k]),
                    sum((len(members[b]) - 1) * len(b[-1][1]) for b in below[k] if b), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
                   for r in df.collect()), key=str)


def conversations():
    rng = random.Random(6)
    rows = []
    for c in [*range(60), *range(100, 160), *range(205, 240), 100000]:
        for t in range(rng.randint(0, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "é𝔸", "", "a b"])))
    rows += [(c, t, "user", f"hot {t}") for c in range(160, 200) for t in range(9)]  # copies
    rows += [(c, t, "user", f"hot {t}" if t < 30 else f"{c} {t}") for c in (300, 301, 302) for t in range(60)]
    rows += [(400, None, None, None), (400, None, "user", None), (400, 0, "user", "x"), (401, 1, "user", "x"), (401, 1, "user", "x"), (401, 1, "tool", "x")]
    rows += [(None, 0, "user", "no id"), (500, 0, "user", "y" * 50_000), (502, 0, "user", "y" * 50_000)]
    rng.shuffle(rows)
    return rows


def rebuild(rows):
    said = {}
    for c, t, r, x in rows:
        if c is not None:
            said.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    said = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in said.items()}
    out = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = said.get(c - c % 100, [])[:h] + own[h:]
    return out


def test_query_matches_brute_force(spark, tmp_path):
    rows = conversations()
    table(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    assert rows_of(q_trie(spark, str(tmp_path))) == brute(rebuild(rows))


def inputs(spark, convs):
    ids = spark.createDataFrame([(c, "x") for c in convs], "conv_id long, k1 string")
    turns = spark.createDataFrame([(c, i, r, x, 1) for c, t in convs.items() for i, (r, x) in enumerate(t)],
                                  "conv_id long, place long, role string, text string, chars int")
    return ids, turns


@pytest.mark.parametrize("limit", [1, 2, 5, 1000])
def test_top_of_any_size_gives_the_same_rows(spark, limit):
    rng = random.Random(limit)
    convs = {c: [(rng.choice("ab"), rng.choice(["p", "q", ""])) for _ in range(rng.randint(0, 6))] for c in range(150)}
    convs[900] = [("u", str(i)) for i in range(200)]
    convs[901] = convs[900][:150] + [("u", "other")]
    assert rows_of(trie.build(*inputs(spark, convs), limit=limit)) == brute(convs)


def test_equal_digests_of_different_turns_are_found(spark, monkeypatch):
    convs = {c: [("u", str(c % 40)), ("v", str(c))] for c in range(80)}
    seen = []
    inner = trie._paths
    def paths(turns, seed):
        seen.append(seed)
        monkeypatch.setattr(trie, "BITS", 3 if seed == 0 else 64)
        return inner(turns, seed)
    monkeypatch.setattr(trie, "_paths", paths)
    assert rows_of(trie.build(*inputs(spark, convs))) == brute(convs)
    assert seen == [0, 1]


def test_slots_are_minimal_and_checked():
    rng = np.random.default_rng(0)
    k1, k2 = rng.integers(-2**62, 2**62, 5000), rng.integers(0, 3, 5000)
    slots = trie.Slots.build(k1, k2)
    assert sorted(slots.find(k1, k2).tolist()) == list(range(5000))
    assert (slots.find(k1, k2 + 3) == -1).all() and (slots.find(k1 + 1, k2) == -1).all()
    assert len(trie.Slots.build(k1[:0], k2[:0]).find(k1, k2)) == 5000


def test_empty_tables(spark):
    assert trie.build(*inputs(spark, {})).count() == 0
    assert rows_of(trie.build(*inputs(spark, {5: [], 3: []}))) == brute({5: [], 3: []})
