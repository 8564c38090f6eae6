"""Positions inside groups that may be far too large for one task."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def positions(df: DataFrame, by: list[str], block: Column, order: list[str],
              name: str = "idx") -> DataFrame:
    """Zero-based position of each row within ``by``, ordered by block and then ``order``.

    Blocks must grow with the order. Rows are numbered inside (group, block); the offset of a
    block comes from pre-aggregated block counts, so a hot group is spread over its blocks.
    """
    df = df.withColumn("_block", block)
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = df.groupBy(*by, "_block").agg(F.count("*").alias("_n")).withColumn(
        "_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(*by, "_block").orderBy(*order)
    return (df.withColumn("_inside", F.row_number().over(inside) - 1)
            .join(offsets, [*by, "_block"])
            .withColumn(name, (F.col("_offset") + F.col("_inside")).cast("bigint"))
            .drop("_block", "_offset", "_inside"))
