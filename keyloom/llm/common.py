"""Shared plumbing: staged tables in the shared folder, range buckets over a sort key, prefix sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.persist import persist

#: A word is a maximal run of characters outside this class (ASCII white space only).
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Most range buckets in one plan. Per-bucket tables (16 to 40 bytes a row) are therefore under 3 MB and safe to broadcast.
MAX_BUCKETS = 65_536

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    return persist(df, name)


def range_bounds(df: DataFrame, key: str, rows_per_bucket: int) -> list:
    """Ascending cut points that are values of an integer key, the smallest value first: at most MAX_BUCKETS of them.

    One aggregate over the key column alone. Empty if no row has a key.
    """
    n = df.agg(F.count(key)).first()[0]
    if not n:
        return []
    parts = max(1, min(MAX_BUCKETS, math.ceil(n / rows_per_bucket)))
    got = df.agg(
        F.min(key).alias("lo"),
        F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], max(10_000, 4 * parts)).alias("cuts"),
    ).first()
    return sorted({got.lo, *(got.cuts if parts > 1 else [])})


def bucket_of(key: Column, bounds: list) -> Column:
    """Index of the last bound that is not above the key, by binary search; null keys go to bucket 0."""
    if len(bounds) < 2:
        return F.lit(0)
    cuts = F.lit(bounds)
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        mid = ((at["lo"] + at["hi"]) / 2).cast("int")
        below = F.get(cuts, mid) <= key
        keep = at["hi"] - at["lo"] <= 1
        return F.struct(
            F.when(keep | ~below, at["lo"]).otherwise(mid).alias("lo"),
            F.when(keep | below, at["hi"]).otherwise(mid).alias("hi"),
        )

    return F.when(key.isNull(), F.lit(0)).otherwise(F.aggregate(steps, start, halve)["lo"])


def prefix(totals: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Exclusive running sums over a per-bucket table (at most MAX_BUCKETS rows, so one partition may hold it)."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before") for c in columns))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body names it inside a higher-order function."""
    return F.get(F.transform(F.array(value), body), 0)
