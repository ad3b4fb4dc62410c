"""Positions and running sums over a whole ordered table, without one task holding it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import stage


def running(df: DataFrame, order: list[Column], value: str | None = None) -> DataFrame:
    """``df`` with ``position`` (from 1) and ``before``, the sum of ``value`` over earlier rows.

    The table is range-partitioned by ``order`` (let it be total) and written; a partition's
    rows are summed in place and moved by the sums of the partitions before it, of which there
    is one row per partition. Null values count as 0. An empty table gives no row.
    """
    part = df.drop("_part", "position", "before").repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    part = stage(part, "sequence")
    v = F.coalesce(F.col(value), F.lit(0)) if value else F.lit(0)
    sums = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(v).alias("_v"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("_v").over(earlier), F.lit(0)).alias("_v"))
    inside = Window.partitionBy("_part").orderBy(*order)
    own = part.withColumn("position", F.row_number().over(inside)).withColumn("before", F.coalesce(F.sum(v).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = own.join(F.broadcast(offsets), "_part")
    return out.withColumn("position", (F.col("position") + F.col("_n")).cast("bigint")).withColumn("before", F.col("before") + F.col("_v")).drop("_part", "_n", "_v")
