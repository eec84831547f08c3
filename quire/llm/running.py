"""Running totals along each key's order without a key's rows in one task.

A window over a key puts all of its rows into one task. Here the rows are
range-partitioned by key and order and written, totals run inside (partition,
key), and what a key has in earlier partitions is added. Only the first and the
last key of a partition (and the null key) can have any, so that table has at
most three rows a partition and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: How totals of each kind are taken and joined.
KINDS = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def ordered(rows: DataFrame, key: str, order: list[Column], measures: dict[str, tuple[str, Column]], name: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0 in the key's order) and the measures' totals up to and with the row.

    ``measures``: name -> (kind, column of bigint). Rows that ``order`` leaves
    equal stand in the order in which they were read. The result reads a
    table written to the shared folder.
    """
    spark = rows.sparkSession
    measures = {"pos": ("sum", F.lit(1).cast("bigint")), **measures}
    place = [F.col(f"_o{i}") for i in range(len(order))]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    (rows.select("*", *[c.alias(f"_m_{m}") for m, (_, c) in measures.items()], *[o.alias(f"_o{i}") for i, o in enumerate(order)],
                 F.monotonically_increasing_id().alias("_read"))
     .repartitionByRange(n, F.col(key).asc_nulls_first(), *[p.asc_nulls_first() for p in place], F.col("_read"))
     .withColumn("_part", F.spark_partition_id()).write.parquet(path))
    table = spark.read.parquet(path)
    totals = table.groupBy("_part", key).agg(*[KINDS[kind][0](f"_m_{m}").alias(f"_t_{m}") for m, (kind, _) in measures.items()])
    edges = table.groupBy("_part").agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    edge = totals.join(F.broadcast(edges), "_part").where(
        F.col(key).isNull() | F.col(key).eqNullSafe(F.col("_low")) | F.col(key).eqNullSafe(F.col("_high")))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = edge.select(F.col("_part").alias("_p"), F.col(key).alias("_k"), *[
        F.coalesce(KINDS[kind][0](f"_t_{m}").over(earlier), F.lit(0).cast("bigint")).alias(f"_e_{m}") for m, (kind, _) in measures.items()])
    here = Window.partitionBy("_part", key).orderBy(*[p.asc_nulls_first() for p in place], "_read").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = table.select("*", *[KINDS[kind][0](f"_m_{m}").over(here).alias(f"_l_{m}") for m, (kind, _) in measures.items()])
    out = local.join(F.broadcast(offsets), (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    joined = {m: KINDS[kind][1](F.col(f"_l_{m}"), F.coalesce(f"_e_{m}", F.lit(0).cast("bigint"))) for m, (kind, _) in measures.items()}
    joined["pos"] = joined["pos"] - 1
    own = [c for c in rows.columns if c not in measures]
    return out.select(*own, *[c.alias(m) for m, c in joined.items()])
