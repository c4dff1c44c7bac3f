"""Running sums over one row per bucket, without putting all buckets into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 12


def exclusive_prefix(df: DataFrame, key: str, columns: list[str], block_bits: int = BLOCK_BITS) -> DataFrame:
    """Adds {column}_before: the column's sum over all rows with a smaller key (a non-negative integer, unique).

    Keys are summed in blocks of 2^block_bits; only block totals pass through a window without partitions.
    """
    block = F.shiftright(F.col(key).cast("long"), block_bits)
    blocked = df.withColumn("_block", block)
    totals = blocked.groupBy("_block").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    over = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_block", *(F.coalesce(F.sum(f"_{c}").over(over), F.lit(0)).alias(f"_{c}") for c in columns))
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = blocked.join(starts, "_block")
    return out.select(*df.columns, *((F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before") for c in columns))
