"""Joins that Spark has no single operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, value: str) -> DataFrame:
    """(keys, at, value): for each left row, the value of the last right row whose start is not behind it; null before the first.

    One union, one sort by key and time and one window: no row meets more than its predecessor.
    """
    l = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    r = right.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    by = W.partitionBy(*keys).orderBy("_t", "_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_v", F.last("_v", ignorenulls=True).over(by))
    return both.where("_side = 1").select(*keys, F.col("_t").alias(at), F.col("_v").alias(value))
