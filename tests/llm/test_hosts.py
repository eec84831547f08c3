import re

import pytest

from quire.llm import hosts


@pytest.fixture(scope="module")
def pages(spark):
    def build(urls):
        return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return build


URLS = [None, "", "no scheme", "http://", "https://Sub.Example.ORG/es/1", "http://example.org/en/17?x", "http://example.org/en/2#f",
        "http://example.org", "http://a.com/fr/x", "http://acom/fr/", "http://com/de/", "x://B.com?/fr/", "http://b.net/a://c", "http://é.NET/p",
        "http://notexample.org/es/", "http://a.b.co.uk/x"] * 2


def test_host_path_and_rules(pages):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    got = {r["page_id"]: r for r in hosts.judge(pages(URLS)).collect()}
    assert len(got) == len(URLS)
    for k, url in enumerate(URLS):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host):])[0]
            host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        assert (got[k]["host"], got[k]["path"]) == (host, path)
        assert got[k]["rule"] == (best[1] + best[2] if best else None)
        assert got[k]["verdict"] == (best[0] if best else "block" if got[k]["low"] > 0.5 else "allow")


def test_hosts_without_a_rule_fall_on_both_sides(pages):
    urls = ["http://z.example.org/es/1"] * 40 + ["http://y.example.org/de/"] * 40 + ["http://z.example.org/de/", "http://y.example.org/x", "http://k.net/"]
    rules = (hosts.rule("block", "example.org/es/"), hosts.rule("allow", "y.example.org/de/"))
    got = hosts.judge(pages(urls), rules).collect()
    free = {r["host"]: r["verdict"] for r in got if r["rule"] is None}
    assert free["z.example.org"] == "block" and free["y.example.org"] == "allow"


def test_clashing_columns_repeated_ids_and_long_urls(spark):
    rows = [(1, "http://A.com/" + "x" * 200_000, "own", "v", 3.0), (1, "http://A.com/" + "x" * 200_000, "own", "v", 3.0), (None, None, "own", "v", 3.0)]
    got = hosts.judge(spark.createDataFrame(rows, "page_id long, url string, host string, verdict string, low double")).collect()
    assert [(r["page_id"], r["host"], len(r["path"])) for r in sorted(got, key=lambda r: str(r["page_id"]))] == [(1, "a.com", 200_001)] * 2 + [(None, "", 0)]
    assert got[0].asDict().keys() == {"page_id", "host", "path", "rule", "verdict", "rate", "low"}


def test_bad_hosts_are_blocked_and_few_pages_are_not_enough(spark, pages):
    seen = [("bad.com", 1)] * 40 + [("good.com", 0)] * 60 + [("a.mixed.net", 0)] * 30 + [("new.com", 1)] * 1 + [("b.mixed.net", 0)] * 20
    seen += [(f"h{k}.org", 0) for k in range(50)]
    out = spark.createDataFrame(seen, "host string, bad int")
    got = {r["host"]: r for r in hosts.judge(pages([f"http://{h}/" for h in ("bad.com", "good.com", "new.com", "c.mixed.net", "x.zz")]), (), out).collect()}
    assert {h: r["verdict"] for h, r in got.items()} == {"bad.com": "block", "good.com": "allow", "new.com": "allow", "c.mixed.net": "allow", "x.zz": "allow"}
    assert got["good.com"]["rate"] < got["new.com"]["rate"] < got["bad.com"]["rate"] and got["c.mixed.net"]["rate"] < got["x.zz"]["rate"]


def test_no_outcomes_and_empty_table(pages):
    assert {r["verdict"] for r in hosts.judge(pages(["http://a.b/"]), ()).collect()} == {"allow"}
    assert hosts.judge(pages([])).count() == 0


def test_levels(spark):
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([("a.b.co.uk",), ("x.y.com",), ("com",), ("",)], "h string").select("h", *hosts.levels(F.col("h")))
    assert [tuple(r) for r in rows.collect()] == [("a.b.co.uk", "b.co.uk", "co.uk"), ("x.y.com", "y.com", "com"), ("com", "com", "com"), ("", "", "")]


def test_no_python_in_the_plan(pages):
    plan = hosts.judge(pages(URLS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
