"""Ordered work over keys of any size: rows are dealt to ranges of the order, ranges are summed up, sums are scanned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with `part`, the range of the named order that a row is in. Ranges are drawn once and written, so every reader sees the same."""
    return cut(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def before(sums: DataFrame, key: list[str], value: Column) -> Column:
    """Sum of value over the key's earlier parts; sums has a row for each key and part that it has rows in."""
    earlier = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0).cast("long"))


def numbered(df: DataFrame, name: str, key: list[str], *order: str) -> DataFrame:
    """df with each row's number from 0 among those of its key, in the named order. A key with most of the rows is many tasks' work; null is a key too."""
    parts = ranged(df, *key, *order)
    offsets = parts.groupBy(*key, "part").agg(F.count("*").alias("n"))
    offsets = offsets.select(*(F.col(c).alias(f"{c}_of") for c in key), F.col("part").alias("part_of"), before(offsets, key, F.col("n")).alias("offset"))
    within = F.row_number().over(Window.partitionBy(*key, "part").orderBy(*order))
    same = F.col("part") == F.col("part_of")
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_of"))
    joined = parts.withColumn("within", within).join(offsets, same)
    return joined.select(*(F.col(c) for c in df.columns), (F.col("offset") + F.col("within") - 1).alias(name))
