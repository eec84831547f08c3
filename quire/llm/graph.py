"""Connected components of a table of links, by alternating large and small stars.

Every round is two joins and two aggregations over the links; a component of
n nodes is a star around its smallest node after O(log n) rounds. Each round
is written to the shared folder, so its lineage is one scan. Links never
reach the driver: a round ends by comparing a count and an exclusive-or of
hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _both(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the smallest of a node and its neighbours: the larger
    neighbours for a large star, the node and its smaller neighbours for a small star."""
    near = _both(links)
    if not large:
        near = near.where("v < u")
    least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in ``links`` (a, b); component is the smallest node.

    Nulls in a link, links of a node to itself and repeated links add nothing.
    """
    now = _written(links.where("a is not null and b is not null and a != b")
                   .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")))
    state = now.agg(mark).first()[0]
    while state[0]:
        now = _written(_star(_star(now, True), False), "links")
        after = now.agg(mark).first()[0]
        if after == state:
            break
        state = after
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select("b", "b")).distinct()
