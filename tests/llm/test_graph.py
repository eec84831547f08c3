import random

from quire.llm.graph import components


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, 500 + i) for i in range(1, 30)]
    edges += [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(80)] + [(7, 7), (None, 8), (140, 100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
