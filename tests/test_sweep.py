"""Sweeps that are resumed, and models that fail."""

from test_models import planted

from quire.operators import sweep as sw


def test_killed_and_failed_units_are_made_up(spark, tmp_path):
    c = planted(spark, blocks=2, per_block=6)
    sweeps = {a: sw.Sweep(2, 3, 1, 2, top=4) for a in ("nmf", "skm")}
    calls = []

    def counted(name, broken=()):
        def fit(corpus, members, k, sweep):
            calls.append((name, k))
            if (name, k) in broken:
                raise RuntimeError("lost")
            return sw.FITTERS[name](corpus, members, k, sweep)
        return fit

    class Killed(BaseException):
        pass

    def killed(corpus, members, k, sweep):
        raise Killed

    folder = str(tmp_path / "sweep")
    try:
        sw.run_models(c, folder, {"skm": sweeps["skm"]}, {"skm": killed})
        raise AssertionError("it should have been stopped")
    except Killed:
        pass
    first = sw.run_models(c, folder, sweeps, {"nmf": counted("nmf", {("nmf", 2)}), "skm": counted("skm")}).collect()
    assert {(r["algo"], r["k"]): r["state"] for r in first} == {("nmf", 2): "failed", ("nmf", 3): "done", ("skm", 2): "done", ("skm", 3): "done"}
    assert [r["error"] for r in first if r["state"] == "failed"] == ["RuntimeError: lost"]
    assert sw.load(spark, folder, "partitions").select("algo", "k").distinct().count() == 3
    calls.clear()
    again = sw.run_models(c, folder, sweeps, {"nmf": counted("nmf"), "skm": counted("skm")}).collect()
    assert calls == [("nmf", 2)] and all(r["state"] == "done" for r in again)
    ranked = sw.load(spark, folder, "rankings")
    assert ranked.select("algo", "k", "run", "topic").distinct().count() == 2 * 2 * (2 + 3)
    calls.clear()
    sw.run_models(c, folder, {"nmf": sw.Sweep(2, 2, 1, 3, top=4)}, {"nmf": counted("nmf")})  # other parameters
    assert calls == [("nmf", 2)]
