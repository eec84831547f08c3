"""Dense positions in a global order without a single-partition window.

``row_number() over (order by x)`` moves every row into one task. Here the
rows are range-partitioned and sorted inside each partition; each row's
position is its offset inside the partition plus the number of rows of the
same group in earlier partitions. Only a (partition x group) count table,
whose size is bounded by partitions x groups, is broadcast.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def ordered_index(df: DataFrame, order_cols: list[str], name: str,
                  group_cols: list[str] | None = None, base: int = 0,
                  partitions: int | None = None) -> DataFrame:
    """Add ``name`` = position (from ``base``) of each row within its group,
    in the order of ``order_cols``. The order must be total (no ties)."""
    group_cols = list(group_cols or [])
    keys = group_cols + list(order_cols)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_qp", F.spark_partition_id())
        .withColumn("_qm", F.monotonically_increasing_id())
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    counts = ranged.groupBy("_qp", *group_cols).agg(
        F.count(F.lit(1)).alias("_qn"), F.min("_qm").alias("_qfirst")
    )
    w = Window.partitionBy(*group_cols).orderBy("_qp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_qoff", F.coalesce(F.sum("_qn").over(w), F.lit(0))).drop("_qn")
    # partitions x groups rows: bounded, whatever the rows of the table
    out = ranged.join(F.broadcast(offsets), ["_qp", *group_cols])
    pos = F.col("_qoff") + (F.col("_qm") - F.col("_qfirst")) + F.lit(base)
    return out.withColumn(name, pos.cast("bigint")).drop("_qp", "_qm", "_qfirst", "_qoff")
