"""Positions in a global order, without a task that sorts everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.plans.durable import durable


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the row's place, from 0, in the order of these columns, which should tell all rows apart.

    Rows are dealt to ranges of the order and numbered within them; a range begins after the rows of the ranges before it,
    which takes one row a range. The ranges are kept, as sampled bounds may differ when they are computed again.
    """
    ranged = durable(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    begins = sizes.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_begin"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = ranged.withColumn("_within", within).join(F.broadcast(begins), F.col("_range") == F.col("_r"))
    return placed.withColumn(name, F.col("_begin") + F.col("_within") - 1).drop("_range", "_r", "_begin", "_within")
