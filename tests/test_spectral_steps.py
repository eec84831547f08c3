"""Steps of the spectral embedding: what they leave in the shared folder, and rows read as they stand."""

import numpy as np
from test_models import planted, tied

from quire.operators import spectral as sp
from quire.session import cut_lineage


def test_steps_leave_one_version_and_rows_are_not_packed_again(spark, monkeypatch, tmp_path):
    c = planted(spark, blocks=3, per_block=8)
    rows = cut_lineage(tied(spark, c).groupBy("doc_id").agg({"*": "count"}).join(sp.row_lists(tied(spark, c)), "doc_id"))
    want = {r["doc_id"]: r["embedding"] for r in sp.spectral_embedding(rows, c.docs, 18, 2, steps=12).collect()}
    made, most = [], []

    def scratch(session, name):
        most.append(sum(f.stat().st_size for p in made for f in p.rglob("part-*") if p.name.startswith("spectral")))
        made.append(tmp_path / f"{name}-{len(made)}")
        return str(made[-1])

    monkeypatch.setattr(sp, "scratch_path", scratch)
    monkeypatch.setattr(sp, "pack", lambda *a: 1 / 0)
    got = {r["doc_id"]: r["embedding"] for r in sp.spectral_embedding(rows, None, 18, 2, steps=12).collect()}
    assert len(made) == 14 and [any(p.iterdir()) for p in made] == [False] * 13 + [True]
    assert max(most) < 1.5 * max(most[1:3])  # as many bytes before the last step as before the second
    a, b = (np.array([x[i] for i in sorted(x)]) for x in (want, got))
    assert len(a) == 24 and np.allclose(a @ a.T, b @ b.T, atol=1e-9)
