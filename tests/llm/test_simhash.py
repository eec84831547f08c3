import numpy as np
import pytest
import xxhash

from quire.llm import simhash


def fingerprint(text, size=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k:k + size]) for k in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def expected(rows, radius):
    prints = [fingerprint(t) for _, t in rows]
    roots = components(prints, radius)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, roots)), key=str)


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_near_duplicates_match_brute_force(make, corpus, radius):
    got = simhash.near_duplicates(make(corpus), radius=radius)
    assert sorted(map(tuple, got.collect()), key=str) == expected(corpus, radius)


def test_links_join_all_close_fingerprints_over_tiles(spark):
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [p ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for p in prints[:80] for a, b in [rng.integers(0, 64, 2)]]
    chain = [prints[0]]
    for k in range(60):
        chain.append(chain[-1] ^ np.uint64(7 << (k % 60)))
    every = np.unique(np.concatenate([prints, flips, chain]).astype(np.uint64))
    frame = spark.createDataFrame([(int(v),) for v in every.view(np.int64)], "fp long")
    found = {int(a) for r in simhash.links(frame, 3, tile=4).collect() for a in r}
    pairs = simhash.links(frame, 3, tile=4).collect()
    index = {int(v): k for k, v in enumerate(every.view(np.int64))}
    parent = list(range(len(every)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        x, y = find(index[a]), find(index[b])
        parent[max(x, y)] = min(x, y)
    assert [find(k) for k in range(len(every))] == components([int(v) for v in every], 3)
    assert len(found) > 100


def test_offsets_reach_every_difference():
    steps = set(simhash.offsets(3))
    assert len(steps) == 65 and all(tuple(-x for x in s) not in steps for s in steps if any(s))


def test_one_of_each_group_stays(make, corpus):
    got = simhash.drop_near_duplicates(make(corpus))
    assert got.columns == make(corpus).columns
    ids = [r["doc_id"] for r in got.collect()]
    keep = {i for i, _, c in expected(corpus, 3) if i == c and i is not None}
    assert sorted(i for i in ids if i is not None) == sorted(keep)
    assert ids.count(None) == 1  # the empty one is a copy of rows with an id


def test_rows_that_share_an_id_are_told_apart_by_text(make):
    long = lambda s: " ".join(f"{s}{k}" for k in range(40))
    rows = [(1, long("a")), (2, long("b")), (2, long("a")), (2, long("c")), (2, long("c")), (None, long("d")), (None, long("d")), (None, long("a"))]
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(make(rows)).collect()), key=str)
    assert got == sorted([(1, long("a")), (2, long("b")), (2, long("c")), (None, long("d"))], key=str)


def test_empty_table(make):
    assert simhash.near_duplicates(make([])).count() == 0
    assert simhash.drop_near_duplicates(make([])).count() == 0
