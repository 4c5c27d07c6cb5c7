"""Dense numbers over a whole table without putting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settled


def numbered(df: DataFrame, order: Sequence[str], name: str = "n", weight: Column | None = None, before: str = "before") -> DataFrame:
    """df with its 1-based place in `order` (columns that tell rows apart), and with a weight the sum of the weights of the
    rows before. Rows are dealt out in ranges of the order; a range is counted by itself, and the sums of the ranges before it
    (one row a range) are added."""
    ranged = settled(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).withColumn("__w", F.lit(1) if weight is None else weight))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), F.sum("__w").alias("__s"))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(ahead), F.lit(0)).alias("__s0"))
    own = Window.partitionBy("__range").orderBy(*order)
    out = ranged.withColumn("__k", F.row_number().over(own))
    if weight is not None:
        out = out.withColumn("__v", F.coalesce(F.sum("__w").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(F.broadcast(starts), "__range").withColumn(name, F.col("__n0") + F.col("__k"))
    if weight is not None:
        out = out.withColumn(before, F.col("__s0") + F.col("__v"))
    return out.drop("__range", "__w", "__k", "__v", "__n0", "__s0")
