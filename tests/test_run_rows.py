"""Sweeps over rows that name their runs: no members joined, nothing packed again for each unit."""

import pytest
from test_models import planted

from quire.operators import packed as pk
from quire.operators import sampling as sm
from quire.operators import sweep as sw

KEYS = sm.MODEL_KEY


@pytest.mark.parametrize("ratio, runs", [(0.8, 3), (0.5, 2), (1.0, 1), (0.0, 1), (0.8, 0)])
def test_rows_hold_the_runs_whose_samples_have_them(spark, ratio, runs):
    c = planted(spark, blocks=3, per_block=8)
    rows = sm.run_rows(c.rows, c.docs, runs, ratio, 7)
    got = sm.run_row_members(rows, "nmf", 2, 3)
    want = sm.model_members(c.docs.select("doc_id"), "nmf", 2, 3, runs, ratio, 7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.schema.simpleString() == want.schema.simpleString()


def test_packing_rows_with_runs_joins_and_writes_nothing(spark):
    c = planted(spark, blocks=3, per_block=8)
    rows = sm.run_rows(c.rows, c.docs, 2, 0.5, 7)
    members = sm.run_row_members(rows, "skm", 2, 3).where("run > 0")
    packed, keys = pk.pack(rows, members, KEYS)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Join", "Sort")) and packed.inputFiles() == c.rows.inputFiles()
    want, same = pk.pack(c.rows, sm.model_members(c.docs.select("doc_id"), "skm", 2, 3, 2, 0.5, 7).where("run > 0"), KEYS)
    flat = [sorted((r["doc_id"], sorted(r["models"]), r["terms"], r["weights"]) for r in x.collect()) for x in (packed, want)]
    assert keys == same and flat[0] == flat[1] and 0 < len(flat[0]) < 24


def test_units_of_a_sweep_share_the_rows(spark, tmp_path, monkeypatch):
    c = planted(spark, blocks=2, per_block=6)
    made, pack = [], pk.pack
    for module in (sw.nm, sw.ld, sw.km):
        monkeypatch.setattr(module, "pack", lambda rows, members, keys: made.append(pack(rows, members, keys)) or made[-1])
    done = sw.run_models(c, str(tmp_path / "sweep"), {a: sw.Sweep(2, 3, 1, 2, top=4) for a in sw.FITTERS}).collect()
    assert [r["state"] for r in done] == ["done"] * 6, done
    assert len(made) == 6 and not any(
        x in p._jdf.queryExecution().executedPlan().toString() for p, _ in made for x in ("Exchange", "Join"))


def test_kmeans_queries_read_rows_with_runs(spark, monkeypatch):
    from quire.plans import queries_models as qm

    seen, kmeans = [], qm.km.kmeans
    monkeypatch.setattr(qm.km, "kmeans", lambda *a, **more: seen.append((a, more)) or kmeans(*a, **more))
    c = planted(spark, blocks=3, per_block=8)
    monkeypatch.setattr(qm, "corpus", lambda *a, **more: c)
    _, _, assign, _ = qm._skm(spark, "")
    (rows, members, init, keys), more = seen[0]
    assert "runs" in rows.columns
    plain = sm.model_members(c.docs.select("doc_id"), "skm", 2, 3, qm.SWEEP_RUNS, qm.O.RATIO, qm.O.SEED)
    _, want, _ = kmeans(c.rows, plain, init, keys, max_iter=more["max_iter"], topics=more["topics"])
    pick = [*keys, "doc_id", "topic"]
    assert sorted(map(tuple, assign.select(*pick).collect())) == sorted(map(tuple, want.select(*pick).collect()))
