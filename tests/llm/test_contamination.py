import re

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import contamination
from quire.llm import words as wd


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def expected(rows, items, window):
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[s:s + window]), set()).add(i)
    out = []
    for d, t in rows:
        w = words(t)
        hit, found = [False] * len(w), set()
        for size in {len(k) for k in wins}:
            for s in range(len(w) - size + 1):
                got = wins.get(tuple(w[s:s + size]))
                if got:
                    found |= got
                    hit[s:s + size] = [True] * size
        out.append((d, len(w), sum(hit), sorted(found - {None}) + [None] * (None in found)))
    return sorted(out, key=str)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def tests(corpus):
    texts = {i: t for i, t in corpus if t}
    cut = lambda i, a, b: " ".join(texts[i].split()[a:b])
    return [(1, cut(60, 32, 60).upper()), (2, cut(63, 20000, 20025)), (3, "one"), (4, "One-Two!"), (5, None), (6, ""), (7, "..."),
            (8, cut(71, 0, 9)), (9, cut(71, 0, 11) + " unknown"), (1, cut(12, 0, 12)), (10, cut(63, 5, 300)), (None, cut(71, 0, 12))]


@pytest.mark.parametrize("shard, block", [(4 << 20, 1 << 18), (600, 8)])
def test_matches_brute_force(spark, make, corpus, tests, monkeypatch, shard, block):
    monkeypatch.setattr(contamination, "SHARD", shard)
    monkeypatch.setattr(contamination, "BLOCK_WORDS", block)
    got = contamination.annotate(make(corpus), items(spark, tests), 10)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()), key=str) == expected(corpus, tests, 10)


def test_longest_match_and_where(spark, make):
    body = [f"w{k}" for k in range(60)]
    docs = make([(1, " ".join(body)), (2, " ".join(body[:5] + ["x"] + body[20:33])), (3, "nothing here")])
    got = {r["doc_id"]: (r["longest_match"], r["longest_item"], r["longest_at"]) for r in contamination.annotate(
        docs, items(spark, [(7, " ".join(["y", *body[18:40], "z"]))])).collect()}
    assert got == {1: (22, 7, 18), 2: (13, 7, 6), 3: (0, None, None)}


@pytest.mark.parametrize("shard, block", [(4 << 20, 1 << 18), (600, 8)])
def test_longest_match_of_every_copy(spark, make, corpus, tests, monkeypatch, shard, block):
    monkeypatch.setattr(contamination, "SHARD", shard)
    monkeypatch.setattr(contamination, "BLOCK_WORDS", block)
    passage = [f"w{k}" for k in range(40)]
    copies = [(100 + k, " ".join([f"a{k}", *passage[k % 3:], "w3 w4 w5"])) for k in range(6)] + [(110, " ".join(passage[:12])), (111, "w39")]
    rows = [(i, t) for i, t in corpus if i != 63 and i != 64] + copies
    named = tests + [(None, " ".join(["q", *passage[20:]])), (21, " ".join(["y", *passage, "z"])), (20, " ".join([*passage[:12], "q"]))]
    texts = [(i, f" {' '.join(words(t))} ") for i, t in named]

    def longest(text):
        w = words(text)
        for size in range(len(w), 0, -1):
            for at in range(len(w) - size + 1):
                ids = [i for i, t in texts if f" {' '.join(w[at:at + size])} " in t]
                if ids:
                    return size, min((i for i in ids if i is not None), default=None), at
        return 0, None, None

    docs = make(rows).coalesce(1)
    got = [(r["doc_id"], r["longest_match"], r["longest_item"], r["longest_at"]) for r in contamination.annotate(docs, items(spark, named)).collect()]
    assert sorted(got, key=str) == sorted(((i, *longest(t)) for i, t in rows), key=str)


def test_clean_documents_stay_whole(spark, make, corpus, tests):
    got = contamination.decontaminate(make(corpus), items(spark, tests), 10)
    assert got.columns == make(corpus).columns
    clean = [x[0] for x in expected(corpus, tests, 10) if not x[2]]
    rows = got.collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted(clean, key=str)
    assert {r["n_words"] for r in rows} == {"own"}


def test_query_agrees_with_sql_on_an_item_without_id(spark, make, corpus, tests, tmp_path):
    import duckdb
    from quire.llm.queries import DECONTAMINATION_SQL, q_decontamination

    make([r for r in corpus if r[0] is not None and r[0] not in (63, 64, 70)], clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    items(spark, tests).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = q_decontamination(spark, str(tmp_path))
    want = con.sql(DECONTAMINATION_SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {r["doc_id"]: r["n_hit"] for r in got.collect()}[71] > 0


def test_empty_tables(spark, make, corpus, tests):
    assert contamination.annotate(make([]), items(spark, tests)).count() == 0
    assert contamination.decontaminate(make(corpus), items(spark, [])).count() == len(corpus)


def test_suffix_array_is_sorted_to_its_depth():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 3, 400)
    for depth in (1, 2, 7, 400):
        order = contamination.SuffixArray(text, depth).order
        heads = [tuple(text[i:i + depth]) for i in order]
        assert heads == sorted(heads) and sorted(order) == list(range(400))


def test_no_match_across_documents():
    s = next(wd.word_slices(pa.array(["a b", "c d"]), wd.ALNUM))
    shard = contamination.Shard(s, 4)
    pattern = shard.codes(np.concatenate([wd_hash(x) for x in ("b", "c")]))
    lo = shard.array.search(pattern, np.array([0]), np.array([2]), False)
    hi = shard.array.search(pattern, np.array([0]), np.array([2]), True)
    assert lo == hi


def wd_hash(word):
    s = next(wd.word_slices(pa.array([word]), wd.ALNUM))
    return s.hashes()[s.codes]
