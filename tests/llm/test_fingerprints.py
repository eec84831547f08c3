import collections
import hashlib
import random
import re
import struct

import pytest
import xxhash

from quire.llm import fingerprints as fp


def words(text):
    return {w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w}


def direct(rows):
    """By document id: (characters, digest of the edited text, fingerprint, edited, next) for unique ids."""
    rows = sorted(rows)
    texts = [t or "" for _, t in rows]
    df = collections.Counter(w for t in texts for w in words(t))

    def simhash(text):
        votes, total = [0] * 128, 0
        for w in words(text):
            a = xxhash.xxh64_intdigest(w.encode(), 42)
            b = xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)
            n = df.get(w, 0)
            weight = 4 if n * 256 < len(rows) else 1 if n * 4 >= len(rows) else 2 if n * 32 >= len(rows) else 3
            total += weight
            for i in range(64):
                votes[i] += weight * (a >> i & 1)
                votes[64 + i] += weight * (b >> i & 1)
        bit = [2 * v > total for v in votes]
        return sum(x << i for i, x in enumerate(bit[:64])) << 64 | sum(x << i for i, x in enumerate(bit[64:]))

    prints, out = [simhash(t) for t in texts], {}
    for k, (i, _) in enumerate(rows):
        t, nxt = texts[k], texts[(k + 1) % len(rows)]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        e = simhash(edited)
        same = lambda x, y: 1 - (x ^ y).bit_count() / 128
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{prints[k]:032x}", f"{e:032x}",
                  same(prints[k], e), same(prints[k], prints[(k + 1) % len(rows)]))
    return out, prints


@pytest.fixture(scope="module")
def unique(corpus):
    seen = {i: t for i, t in corpus if i is not None and i not in (63, 64)}
    seen[63] = "word " * 30000 + "end"
    return sorted(seen.items())


def test_matches_brute_force(make, unique):
    got = fp.compare_with_edits(make(unique)).collect()
    want, _ = direct(unique)
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"])
            for r in got} == want


@pytest.mark.parametrize("radius", [3, 20])
def test_neighbours_match_brute_force(make, unique, radius):
    rows = fp.with_neighbours(fp.compare_with_edits(make(unique)), radius).collect()
    _, prints = direct(unique)
    want = {i: any((p ^ q).bit_count() <= radius for k, q in enumerate(prints) if k != j) for j, ((i, _), p) in enumerate(zip(unique, prints))}
    assert {r["doc_id"]: r["has_near"] for r in rows} == want


@pytest.mark.parametrize("radius", [3, 20])
def test_links_and_classes_match_brute_force(spark, radius):
    near = [7, 7, 7 ^ 1 << 63, 7 ^ 0b11 << 30, 7 ^ 0b11 << 30 ^ 0b111 << 90, 1 << 127, 1 << 127 | 1 << 64, 0xABCDEF << 70, 7 ^ 0x1F << 20]
    rng = random.Random(3)
    prints = near + [rng.getrandbits(128) for _ in range(60)]
    prints += [p ^ 1 << rng.randrange(128) ^ 1 << rng.randrange(128) for p in prints[-40:]]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(i, signed(p >> 64), signed(p & (1 << 64) - 1)) for i, p in enumerate(prints)]
    got = {r["doc_id"]: r for r in fp.with_neighbours(spark.createDataFrame(rows, "doc_id long, f0 long, f1 long"), radius).collect()}
    links = {i: {j for j, q in enumerate(prints) if j != i and (p ^ q).bit_count() <= radius} for i, p in enumerate(prints)}
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(v) for i, v in links.items()}
    for i in links:
        found, new = {i}, {i}
        while new:
            new = {j for k in new for j in links[k]} - found
            found |= new
        least = min(rows[j][1:] for j in found)
        assert got[i]["class"] == "".join(f"{v & (1 << 64) - 1:016x}" for v in least)


def test_search_finds_every_pair_once(make, unique):
    prints = fp.compare_with_edits(make(unique)).select("doc_id", "f0", "f1")
    asked = prints.where("doc_id % 3 = 0").selectExpr("f0 as q0", "f1 as q1")
    got = [tuple(r) for r in fp.neighbours(prints, asked, 12).collect()]
    rows = {(r["f0"], r["f1"]) for r in prints.collect()}
    queries = {tuple(r) for r in asked.collect()}
    mask = (1 << 64) - 1
    want = {(*q, *p) for q in queries for p in rows if ((q[0] ^ p[0]) & mask).bit_count() + ((q[1] ^ p[1]) & mask).bit_count() <= 12}
    assert len(got) == len(set(got)) and set(got) == want


def test_repeated_rows_and_null_ids_have_one_row_each(make, corpus):
    got = fp.compare_with_edits(make(corpus)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in corpus)


def test_small_tables(make):
    assert fp.with_neighbours(fp.compare_with_edits(make([]))).count() == 0
    only = fp.compare_with_edits(make([(1, "abcd")])).first()
    assert only["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and only["near_next"] == 1.0


def test_buckets_inside_bounds(spark, make, unique, monkeypatch):
    monkeypatch.setattr(fp, "BOUNDS", 3)
    got = {r["doc_id"]: r["edited_sha256"] for r in fp.compare_with_edits(make(unique)).collect()}
    assert got == {i: v[1] for i, v in direct(unique)[0].items()}


def test_no_python_in_the_plan(make, unique):
    plan = fp.with_neighbours(fp.compare_with_edits(make(unique)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
