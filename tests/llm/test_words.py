import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import arrays as ar
from quire.llm import words as wd

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aBZ 9.-\n\t\x0b\x85 éK日'|")), max_size=30)), max_size=8)


@pytest.mark.parametrize("table, pattern", [
    (wd.LOWER, r"[^\x20\x09-\x0D]+"), (wd.AS_IS, r"[^\x20\x09-\x0D]+"), (wd.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
@settings(max_examples=60, deadline=None)
@given(texts=TEXTS, limit=st.sampled_from([1, 20, 10000]))
def test_words_match_the_pattern(table, pattern, texts, limit):
    lower = {c: c + 32 for c in range(65, 91)}
    expected = [re.findall(pattern, (t or "") if table is wd.AS_IS else (t or "").translate(lower)) for t in texts]
    got = []
    for s in wd.word_slices(pa.array(texts, pa.string()), table, limit):
        names = s.names.to_pylist()
        got += [[names[c] for c in s.codes[a:e]] for a, e in zip(s.starts, s.ends)]
    assert got == expected


def test_sliced_column():
    col = pa.array(["a b", None, "c", "d e f"])[1:]
    s = list(wd.word_slices(col, wd.AS_IS))
    assert [x.counts.tolist() for x in s] == [[0, 1, 3]]


def test_arrays_come_back_and_may_be_written_twice(tmp_path):
    uri = f"file://{tmp_path}/a/b.npy"
    for _ in range(2):
        ar.save(uri, np.arange(5))
    assert ar.load(uri).tolist() == [0, 1, 2, 3, 4]
    ar.save(f"{tmp_path}/none.npy", np.zeros(0, np.int64))
    assert len(ar.load(f"{tmp_path}/none.npy")) == 0
    at, found = ar.position(np.array([2, 4, 9]), np.array([1, 4, 9, 10]))
    assert found.tolist() == [False, True, True, False] and at[1:3].tolist() == [1, 2]


def test_by_shard():
    got = {k: rows.tolist() for k, rows in ar.by_shard(np.array([2, 70000, 2, 0]))}
    assert got == {0: [3], 2: [0, 2], 70000: [1]}
    assert list(ar.by_shard(np.zeros(0, np.int64))) == []
