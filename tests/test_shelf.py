"""Passes over mapped documents: what a step writes, and sums of blocks without a shuffle."""

import numpy as np
import pytest
from pyspark.sql import DataFrame
from test_models import planted, tied

from quire.operators import blocks as bl
from quire.operators import packed as pk
from quire.operators import spectral as sp


def test_spectral_steps_write_vectors_only_and_pass_once(spark, monkeypatch, tmp_path):
    c = planted(spark, blocks=3, per_block=8)
    rows = sp.row_lists(tied(spark, c))
    made, most, passes = [], [], []

    def scratch(session, name):
        most.append(sum(f.stat().st_size for p in made for f in p.rglob("part-*") if p.name.startswith("spectral")))
        made.append(tmp_path / f"{name}-{len(made)}")
        return str(made[-1])

    monkeypatch.setattr(sp, "scratch_path", scratch)
    if hasattr(pk, "mapped"):
        run = pk.mapped
        monkeypatch.setattr(pk, "mapped", lambda *a, **more: passes.append(1) or run(*a, **more))
    assert sp.spectral_embedding(rows, None, 18, 2, steps=6).count() == 24
    numbers = 24 * (2 + 2 + 1 + 4) * 8  # a root, a square and a vector for each document
    assert numbers <= most[2] <= max(most) <= numbers + 24 * 128  # at most a header for each document
    assert len(passes) == 2 + 6 + 1  # column sums, start, a pass for each step, embedding


@pytest.mark.parametrize("limit", [64 << 20, 100])
def test_units_hold_all_documents_and_rounds_shuffle_nothing(spark, monkeypatch, limit):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((40, 30)) < 0.3, rng.random((40, 30)), 0)
    x[7] = 0
    data = [(f"d{i}", [0], np.flatnonzero(v).tolist(), v[v > 0].tolist()) for i, v in enumerate(x)]
    packed = spark.createDataFrame(data, "doc_id string, models array<int>, terms array<int>, weights array<double>").repartition(3)
    monkeypatch.setattr(pk, "UNIT_NNZ", 50)
    monkeypatch.setattr(pk, "GROUP_BYTES", limit)
    monkeypatch.setattr(bl, "BLOCK_BYTES", 100)
    shelf = pk.shelve(packed)
    monkeypatch.setattr(DataFrame, "repartition", lambda *a: 1 / 0)
    sides = []
    for documents in (shelf, packed):
        side = bl.create(spark, 30, {0: 2}, lambda m, low, high: np.ones((2, high - low)), "test")
        small, sums = bl.totals(documents, side, [0], lambda rows, m, c, extra: (
            rows.transposed(np.stack([rows.times(c)[:, 0], np.ones(len(rows.ends))], axis=1), c.shape[1]), np.array([len(rows.ends)])))
        side, parts = bl.renew(spark, side, sums, lambda m, old, num, extra, low: (old + num, num.sum(1)))
        assert small[0] == [40] and np.allclose(np.sum(parts[0], axis=0), [(x.sum(1) ** 2).sum(), x.sum()])
        sides.append(side.take(0, np.arange(30)))
        assert not [f for f in bl._place(sums.folder)[0].get_file_info(bl.fs.FileSelector(bl._place(sums.folder)[1]))]
    want = 1 + np.stack([x.T @ x.sum(1), x.sum(0)])
    assert np.allclose(sides[0], want) and np.allclose(sides[1], want)
    assert sorted(i for n in range(len(shelf.units)) for i in shelf.read(n).column("doc_id").to_pylist()) == sorted(r[0] for r in data)
