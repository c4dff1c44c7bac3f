"""Key sets: reading, deduplicating, generating and sampling, and writing report rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines of text files, as key."""
    return spark.read.text(path).select(F.col("value").alias("key")).distinct()


def distinct_keys(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of a column, cast to string, as key."""
    return df.select(F.col(column).cast("string").alias("key")).filter("key is not null").distinct()


def dedupe_lines(df: DataFrame, column: str) -> DataFrame:
    """Distinct lines of a text column without surrounding spaces, as line."""
    return df.select(F.explode(F.split(column, "\n", -1)).alias("line")).select(F.trim("line").alias("line")).distinct()


def sample_keys(df: DataFrame, condition: Column, column: str, n: int, seed: int = 42) -> DataFrame:
    """n values of a column from the rows that meet a condition, in the order of a seeded digest."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("key")).cast("binary"))
    return df.filter(condition).select(F.col(column).cast("string").alias("key")).distinct().orderBy(order, "key").limit(n)


def random_string(row: Column, length: int, seed: int = 1) -> Column:
    """A string of letters and digits that depends on the row number and the seed alone."""
    letter = lambda i: F.substring(F.lit(ALPHABET), (F.pmod(F.xxhash64(F.lit(seed), row, i), F.lit(len(ALPHABET))) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), letter), "")


def random_keys(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """n distinct random keys of max(10, ceil(ln n / ln 62)) characters; repeats are replaced until there are none."""
    length = max(10, math.ceil(math.log(max(n, 2)) / math.log(len(ALPHABET))))
    keys = spark.range(n).select(random_string(F.col("id"), length, seed).alias("key")).distinct()
    missing = n - keys.count()
    more = n
    while missing > 0:
        keys = keys.unionByName(spark.range(more, more + missing).select(random_string(F.col("id"), length, seed).alias("key"))).distinct()
        more, missing = more + missing, n - keys.count()
    return keys


def write_report(report: DataFrame, path: str) -> None:
    """Report rows as CSV with a header."""
    report.write.mode("overwrite").option("header", True).csv(path)
