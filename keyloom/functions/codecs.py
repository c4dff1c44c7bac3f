"""Integer codecs as column expressions: Golomb-Rice, Elias-Fano, bit strings, and Golomb parameters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GOLDEN = (1 + math.sqrt(5)) / 2


def _shift(way: str, x: Column, bits: Column) -> Column:
    return F.call_function(f"shift{way}", x.cast("long"), bits.cast("int"))


def _low_mask(bits: Column) -> Column:
    return _shift("left", F.lit(1), bits) - 1


def golomb_rice_encode(value: Column, r: Column) -> Column:
    """struct(fixed, unary): the r low bits from the highest down, and value >> r zeros closed by a one. Exact for every
    non-negative long and r up to 62."""
    low = F.when(r > 0, F.lpad(F.bin(value.cast("long").bitwiseAND(_low_mask(r))), r, "0")).otherwise("")
    return F.struct(low.alias("fixed"), F.concat(F.repeat(F.lit("0"), _shift("right", value, r).cast("int")), F.lit("1")).alias("unary"))


def golomb_rice_decode(fixed: Column, unary: Column) -> Column:
    low = F.when(fixed == "", F.lit(0)).otherwise(F.conv(fixed, 2, 10).cast("long"))
    return _shift("left", F.length(unary) - 1, F.length(fixed)).bitwiseOR(low)


def golomb_parameter(p: Column) -> Column:
    """The best parameter for geometric values with success probability p."""
    best = F.ceil(F.log2(-F.log(F.lit(GOLDEN)) / F.log(1 - p)))
    return F.when(p >= 1, F.lit(0)).otherwise(F.greatest(best, F.lit(0))).cast("int")


def bijection_parameter(m: Column) -> Column:
    """For the seeds of bijections of m keys: p = sqrt(2 pi m) / e^m."""
    return golomb_parameter(F.sqrt(2 * F.lit(math.pi) * m) / F.exp(m))


def split_parameter(parts: Column) -> Column:
    """For the seeds of splits into parts of the given sizes: p = 1 / sqrt((2 pi)^(s - 1) product / sum)."""
    d = lambda x: x.cast("double")
    product = F.aggregate(parts, F.lit(1.0), lambda a, x: a * d(x))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + d(x))
    return golomb_parameter(1 / F.sqrt(F.pow(F.lit(2 * math.pi), F.size(parts) - 1) * product / total))


def bits_lsb_first(x: Column) -> Column:
    return F.reverse(F.bin(x))


def bits_to_int(bits: Column) -> Column:
    return F.conv(F.reverse(bits), 2, 10).cast("long")


def highest_bit(x: Column) -> Column:
    """floor(log2 x), and -1 for 0."""
    return F.when(x > 0, F.length(F.bin(x)) - 1).otherwise(-1)


def log2_approx(x: Column) -> Column:
    """log2 x to the nearest power by size: floor(log2(1.5 x)) of a long up to 2^61; -1 for 0."""
    return F.when(x > 0, highest_bit(3 * x) - 1).otherwise(-1)


def low_bits(n: Column, top: Column) -> Column:
    """Bits that Elias-Fano keeps of each of n values up to top: ceil(log2(ceil(top / n))), 0 if there is nothing."""
    q = F.call_function("div", top - 1, n) + 1
    return F.when((n == 0) | (top <= n), 0).otherwise(F.length(F.bin(q - 1))).cast("int")


#: Values of a group that are coded together; a row of elias_fano_blocks() holds no more.
BLOCK_VALUES = 1 << 15


def elias_fano_blocks(values: DataFrame, group: str, order: str, value: str, block: int = BLOCK_VALUES) -> DataFrame:
    """Each group's ascending values as consecutive parts of its streams: group, block (from 0), upper, lower, m (the
    largest), n, l.

    The upper part has, for each value, as many zeros as its high part is above the one before, then a one; the lower
    part has its l low bits from the highest down. So a group of any size takes rows of bounded size.
    """
    own = values.groupBy(group).agg(F.count(value).alias("n"), F.max(value).alias("m")).withColumn("l", low_bits(F.col("n"), F.col("m")))
    w = Window.partitionBy(group).orderBy(order)
    placed = values.withColumn("at", F.row_number().over(w) - 1).withColumn("before", F.lag(value).over(w)).join(own, group)
    high = lambda c: _shift("right", c, F.col("l"))
    bits = F.struct(
        F.col("at"),
        F.concat(F.repeat(F.lit("0"), (high(F.col(value)) - F.coalesce(high(F.col("before")), F.lit(0))).cast("int")), F.lit("1")).alias("u"),
        F.when(F.col("l") > 0, F.lpad(F.bin(F.col(value).cast("long").bitwiseAND(_low_mask(F.col("l")))), F.col("l"), "0")).otherwise("").alias("w"),
    )
    packed = placed.groupBy(group, F.floor(F.col("at") / block).alias("block")).agg(F.sort_array(F.collect_list(bits)).alias("b"), *(F.first(c).alias(c) for c in ("m", "n", "l")))
    return packed.select(group, "block", F.array_join("b.u", "").alias("upper"), F.array_join("b.w", "").alias("lower"), "m", "n", "l")


def elias_fano_encode(values: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Each group's ascending values in one row: group, upper, lower, m, n, l, for groups whose streams fit a row."""
    parts = elias_fano_blocks(values, group, order, value).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("block", "upper", "lower"))).alias("b"), *(F.first(c).alias(c) for c in ("m", "n", "l")))
    return parts.select(group, F.array_join("b.upper", "").alias("upper"), F.array_join("b.lower", "").alias("lower"), "m", "n", "l")


def elias_fano_decode(codes: DataFrame, group: str) -> DataFrame:
    """group, i (from 0), value of every encoded value: the position of the i-th one, less i, is its high part."""
    spot = F.posexplode(F.split("upper", ""))
    ones = codes.select(group, "lower", "l", spot.alias("pos", "bit")).filter("bit = '1'")
    i = F.row_number().over(Window.partitionBy(group).orderBy("pos")) - 1
    low = F.when(F.col("l") > 0, F.conv(F.substring("lower", F.col("i") * F.col("l") + 1, F.col("l")), 2, 10).cast("long")).otherwise(0)
    return ones.withColumn("i", i).select(group, "i", _shift("left", F.col("pos") - F.col("i"), F.col("l")).bitwiseOR(low).alias("value"))


def elias_fano_space(n: Column, top: Column, low: Column) -> Column:
    """Bits of both parts: n l + n + (top >> l)."""
    return F.when(n == 0, 0).otherwise(n * low + n + _shift("right", top, low)).cast("long")
