"""Bit vectors as rows (pos, bit): packing, rank, select, and the two-level counts behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import exclusive_prefix

#: Positions per block of a running sum: a window never spans more than this many rows.
BLOCK_BITS = 16


def pack_words(bits: DataFrame) -> DataFrame:
    """(word_no, word): 64 bits a word, the lowest position in the lowest bit, as a long in two's complement."""
    at = F.pmod(F.col("pos"), F.lit(64)).cast("int")
    value = F.call_function("shiftleft", F.col("bit").cast("long"), at)
    return bits.groupBy(F.floor(F.col("pos") / 64).alias("word_no")).agg(F.bit_or(value).alias("word"))


def unpack_words(words: DataFrame) -> DataFrame:
    """(pos, bit) of packed words."""
    each = words.select("word_no", "word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return each.select((F.col("word_no") * 64 + F.col("i")).alias("pos"), F.call_function("shiftrightunsigned", F.col("word"), F.col("i")).bitwiseAND(F.lit(1)).cast("int").alias("bit"))


def popcount(word: Column) -> Column:
    return F.bit_count(word)


def with_rank(bits: DataFrame) -> DataFrame:
    """Adds rank (ones before the position) and rank_inclusive (up to and with it)."""
    blocked = bits.withColumn("_block", F.shiftright("pos", BLOCK_BITS))
    totals = blocked.groupBy("_block").agg(F.sum("bit").alias("_ones"))
    starts = totals.select("_block", F.coalesce(F.sum("_ones").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.sum("bit").over(Window.partitionBy("_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    out = blocked.join(starts, "_block").withColumn("rank_inclusive", (F.col("_start") + inside).cast("long"))
    return out.withColumn("rank", F.col("rank_inclusive") - F.col("bit")).drop("_block", "_start")


def select_ones(bits: DataFrame) -> DataFrame:
    """(r, pos): the position of the r-th one, r from 1."""
    return with_rank(bits).filter("bit = 1").select(F.col("rank_inclusive").alias("r"), "pos")


def select_at(bits: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (r) with the position of the r-th one; 0 for r = 0, null beyond the last."""
    found = queries.join(select_ones(bits), "r", "left")
    return found.withColumn("pos", F.when(F.col("r") == 0, F.lit(0)).otherwise(F.col("pos")).cast("long"))


def rank9_counts(words: DataFrame) -> DataFrame:
    """Per block of 8 words: block, ones before it, and the seven counts inside it packed 9 bits each."""
    ones = words.select(F.floor(F.col("word_no") / 8).alias("block"), F.pmod("word_no", F.lit(8)).cast("int").alias("k"), F.bit_count("word").cast("long").alias("ones"))
    inside = F.sum("ones").over(Window.partitionBy("block").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    packed = ones.withColumn("before", inside).withColumn("part", F.when(F.col("k") > 0, F.call_function("shiftleft", F.col("before"), 9 * (F.col("k") - 1))).otherwise(F.lit(0)))
    blocks = packed.groupBy("block").agg(F.sum("ones").alias("ones"), F.bit_or("part").alias("inside"))
    return exclusive_prefix(blocks, "block", ["ones"]).select("block", F.col("ones_before").alias("before"), "inside")


def rank9_at(words: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (pos) with the ones before each position, by block count, packed count and a popcount."""
    at = queries.withColumn("block", F.floor(F.col("pos") / 512)).withColumn("word_no", F.floor(F.col("pos") / 64))
    k = F.pmod("word_no", F.lit(8)).cast("int")
    in_block = F.when(k == 0, F.lit(0)).otherwise(F.call_function("shiftrightunsigned", F.col("inside"), 9 * (k - 1)).bitwiseAND(F.lit(511)))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("pos", F.lit(64)).cast("int")) - 1
    joined = at.join(rank9_counts(words), "block").join(words, "word_no")
    low = F.when(F.pmod("pos", F.lit(64)) == 63, F.col("word").bitwiseAND(F.lit((1 << 63) - 1))).otherwise(F.col("word").bitwiseAND(mask))
    return joined.select("pos", (F.col("before") + in_block + F.bit_count(low)).cast("long").alias("rank"))


def rank9_space(words: Column, blocks: Column) -> Column:
    """Bits of the words and of two counts a block."""
    return 64 * (words + 2 * blocks)


def select_inventory(bits: DataFrame, large: int = 128, small: int = 8) -> DataFrame:
    """Inclusive ranks sampled for selection: pos, primary_rank (the count at its large sample), secondary_rank (ones since it).

    The small spacing is ceil(small x ones / bits), the large one small spacing x large / small."""
    stats = bits.agg(F.sum("bit").alias("ones"), F.count("*").alias("n")).select(F.greatest(F.ceil(F.lit(small) * F.col("ones") / F.col("n")), F.lit(1)).cast("long").alias("every"))
    ranked = with_rank(bits).crossJoin(F.broadcast(stats)).filter(F.col("pos") % F.col("every") == 0)
    wide = F.col("every") * (large // small)
    first = ranked.select((F.floor(F.col("pos") / wide)).alias("part"), "pos", "rank_inclusive", (F.col("pos") % wide == 0).alias("is_primary"))
    heads = first.filter("is_primary").select("part", F.col("rank_inclusive").alias("primary_rank"))
    return first.join(heads, "part").select("pos", "primary_rank", (F.col("rank_inclusive") - F.col("primary_rank")).alias("secondary_rank"))
