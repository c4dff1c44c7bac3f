"""Checking, timing and averaging of hash functions over parameter grids."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def verify(hashed: DataFrame, column: str = "mph") -> DataFrame:
    """One row: keys, distinct values, collisions, least and largest value. Minimal perfect: all distinct, 0 to n - 1."""
    own = hashed.groupBy(column).agg(F.count("*").alias("n"))
    return own.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("keys"), F.count(column).alias("distinct_values"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("collisions"), F.min(column).cast("long").alias("least"), F.max(column).cast("long").alias("largest"))


def placed(hashed: DataFrame, n: int, column: str = "mph") -> DataFrame:
    """key, in_range (the value is from 0 to n - 1) and alone (no other key has it), for every key."""
    shared = hashed.groupBy(column).agg(F.count("*").alias("_keys"))
    return hashed.join(shared, column).select("key", F.col(column).between(0, n - 1).alias("in_range"), (F.col("_keys") == 1).alias("alone"))


def parameter_grid(spark: SparkSession, **values: list[float]) -> DataFrame:
    """Every combination of the parameters' values, one column each."""
    return spark.createDataFrame([tuple(map(float, p)) for p in itertools.product(*values.values())], ", ".join(f"{n} double" for n in values))


def timed(build: Callable, look_up: Callable[[object], DataFrame], n: int) -> dict[str, float]:
    """Milliseconds to build and to look every key up, and keys a second. build() must be complete when it returns."""
    begun = time.perf_counter()
    built = build()
    middle = time.perf_counter()
    look_up(built).write.format("noop").mode("overwrite").save()
    end = time.perf_counter()
    return {"build_ms": 1e3 * (middle - begun), "lookup_ms": 1e3 * (end - middle), "build_keys_s": n / (middle - begun), "lookup_keys_s": n / (end - middle)}


def average_reports(runs: DataFrame, keys: list[str], whole: list[str], rates: list[str]) -> DataFrame:
    """Reports of repeated runs: whole numbers as the floor of their mean, rates as means."""
    return runs.groupBy(*keys).agg(*(F.floor(F.avg(c)).cast("long").alias(c) for c in whole), *(F.avg(c).alias(c) for c in rates))


def space_report(parts: DataFrame, n: int) -> DataFrame:
    """component, bits, total_bits, bits_per_key."""
    total = parts.agg(F.sum("bits").cast("long").alias("total_bits"))
    return parts.crossJoin(F.broadcast(total)).withColumn("bits_per_key", F.col("total_bits") / F.lit(float(max(n, 1))))
