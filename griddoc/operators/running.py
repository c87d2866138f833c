"""Running values over ordered groups of any size.

A window over a group puts the whole group into one task. Here the rows are cut into ranges of (group, order), whatever the
groups' sizes; each range is folded by itself, and what the ranges before it add is computed from one row per group and range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from griddoc.session import checkpointed, small


def ranges(rows: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """rows with the number of their range (_range); written down, so that every use sees the same ranges."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(rows.repartitionByRange(n, *within, *order).withColumn("_range", F.spark_partition_id()))


def joined(cut: DataFrame, of_range: DataFrame, within: list[str]) -> DataFrame:
    """cut with the row of of_range of its group and range; null groups are groups of their own."""
    keys = [*within, "_range"]
    b = of_range.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return cut.join(small(checkpointed(b)), on, "left").drop(*(f"_k{i}" for i in range(len(keys))))


def running_sum(rows: DataFrame, within: list[str], order: list[str], value: str, to: str) -> DataFrame:
    """rows with column to: the sum of value over the rows of the group up to and with this one. order must tell rows apart."""
    cut = ranges(rows, within, order)
    of_range = cut.groupBy(*within, "_range").agg(F.sum(value).alias("_sum"))
    earlier = F.sum("_sum").over(W.partitionBy(*within).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    of_range = of_range.select(*within, "_range", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    here = F.sum(value).over(W.partitionBy(*within, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return joined(cut, of_range, within).withColumn(to, F.col("_earlier") + here).drop("_earlier", "_range")


def previous(rows: DataFrame, within: list[str], order: list[str], value: str, to: str) -> DataFrame:
    """rows with column to: value of the row before in the group, null for the first. order must tell rows apart."""
    cut = ranges(rows, within, order)
    of_range = cut.groupBy(*within, "_range").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    of_range = of_range.select(*within, "_range", F.lag("_last").over(W.partitionBy(*within).orderBy("_range")).alias("_before"))
    here = F.lag(value).over(W.partitionBy(*within, "_range").orderBy(*order))
    return joined(cut, of_range, within).withColumn(to, F.coalesce(here, F.col("_before"))).drop("_before", "_range")
