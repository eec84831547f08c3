import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quire.llm import packing
from quire.llm.queries import tokenizer_path

ODD = ["don't, we'll: it's 5o'clock", "É Ça×b÷c ñÑ", "x<|endoftext|>y <|startoftext|>", "a\u0301 e\u0308! ***foo###Bar%%%9",
       "ﬁnance ½ ² Ⅷ İstanbul ΣΑΣ 日本語、テスト", "a\u00a0b\u2003c\u200bd\ufeff", "tab\tnew\nline\x0b\x0c\r end\x1c\x1d\x85z", "'s''s 'S'RE I'M",
       "🙂🙂 👩‍👩‍👧 #tag_1-2", "word" * 200, "\x00\x01 \x7f"]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tokenizer_path())


def pieces(tok, rows, capacity):
    out = []
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        out += [(i, k, s, len(ids[s:s + capacity]), zlib.crc32(ids[s:s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    return sorted(out, key=str)


@pytest.mark.parametrize("capacity", [16, 4096])
def test_pieces_are_the_tokenizers(spark, make, corpus, tok, capacity):
    rows = corpus + [(1000 + k, t) for k, t in enumerate(ODD)]
    got = packing.encode(make(rows), tokenizer_path(), capacity)
    assert sorted(map(tuple, got.collect()), key=str) == pieces(tok, rows, capacity)


def test_ids_come_back(make, tok):
    got = packing.encode(make([(1, "Some words, here."), (2, None)]), tokenizer_path(), with_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {1: tok.encode("Some words, here.", add_special_tokens=False).ids + [1], 2: [1]}


def test_a_full_store_of_words_changes_nothing(monkeypatch, tok):
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    enc = packing.Encoder(tokenizer_path())
    for text in ("one two three four five", "six one! two", *ODD[:2]):
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, ends = enc.ids(raw, np.array([0, len(raw)]))
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids and ends.tolist() == [len(ids)]


def packed(spark, lengths, capacity, **more):
    frame = spark.createDataFrame([(k, 0, int(n)) for k, n in enumerate(lengths)], "doc_id long, piece int, length long")
    return packing.pack(frame, capacity, **more).toPandas()


def assert_packed(out, lengths, capacity):
    assert sorted(out.length) == sorted(lengths) and out.doc_id.is_unique
    assert out.groupby("sequence_id").length.sum().max() <= capacity
    out = out.sort_values(["sequence_id", "offset"])
    assert (out.offset == out.groupby("sequence_id").length.cumsum() - out.length).all()


@pytest.mark.parametrize("kind", ["mixed", "large", "small", "equal", "full", "halves"])
def test_near_the_lower_bound(spark, kind):
    rng = np.random.default_rng(4)
    capacity = 256
    lengths = {"mixed": rng.integers(1, 257, 600), "large": rng.integers(86, 200, 300), "small": rng.integers(1, 30, 500),
               "equal": np.full(90, 85), "full": np.full(20, 256), "halves": np.concatenate([np.full(50, 129), np.full(50, 127)])}[kind]
    out = packed(spark, lengths, capacity)
    assert_packed(out, lengths, capacity)
    used, least = out.sequence_id.nunique(), -(-int(lengths.sum()) // capacity)
    # pieces over half a sequence need one each
    least = max(least, int((lengths > capacity // 2).sum()))
    assert used <= least * 1.12 + 2
    if kind in ("equal", "full", "halves"):
        assert used == {"equal": 30, "full": 20, "halves": 50}[kind]


def test_repeated_rows_and_empty_tables(spark, make):
    rows = [(5, "same text")] * 4 + [(None, "no id")] * 2
    out = packing.pack(packing.encode(make(rows), tokenizer_path()), 4096)
    assert out.count() == 6 and out.select("sequence_id").distinct().count() == 1
    assert packing.pack(packing.encode(make([]), tokenizer_path())).count() == 0


def test_groups_have_equal_cardinality():
    groups = packing.linear_groups(np.arange(1, 101), np.full(100, 3), 10)
    assert [g[2] for g in groups] == [30] * 10 and groups[0][:2] == (1, 10)


def test_configurations_hold_every_piece_once():
    sizes, counts = np.array([30, 50, 70]), np.array([41, 23, 17])
    plan = packing.configurations(sizes, counts, 100)
    assert sum(c * t for c, t in plan).tolist() == counts.tolist() and all(c @ sizes <= 100 for c, _ in plan)
    assert sum(t for _, t in plan) <= -(-int(sizes @ counts) // 100) + 5
