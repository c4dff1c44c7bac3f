"""Codecs over the whole range of longs, packed artifacts, and space of every function."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import codecs
from keyloom.operators import recsplit, sichash
from keyloom.plans import catalogue

DIR = "/root/testdata/sf0.001"


def test_golomb_rice_is_exact_up_to_2_62(spark):
    r = random.Random(4)
    cases = [((1 << 53) + 1, 45), ((1 << 62) - 1, 58), ((1 << 62) - 1, 62), (0, 0), (7, 0), (0, 62)]
    cases += [(v, max(0, v.bit_length() - r.randint(0, 9))) for v in (r.getrandbits(r.randint(1, 62)) for _ in range(400))]
    df = spark.createDataFrame(cases, "v long, r int").withColumn("c", codecs.golomb_rice_encode(F.col("v"), F.col("r")))
    for x in df.select("v", "r", "c.*", codecs.golomb_rice_decode(F.col("c.fixed"), F.col("c.unary")).alias("back")).collect():
        assert (x.back, x.unary) == (x.v, "0" * (x.v >> x.r) + "1")
        assert x.fixed == (format(x.v & ((1 << x.r) - 1), f"0{x.r}b") if x.r else "")


def test_elias_fano_is_exact_up_to_2_62_and_over_blocks(spark):
    r = random.Random(6)
    groups = {0: sorted(r.getrandbits(62) for _ in range(50)), 1: [(1 << 53) + 1, (1 << 62) - 1], 2: list(range(200)), 3: [5] * 9}
    df = spark.createDataFrame([(g, i, v) for g, own in groups.items() for i, v in enumerate(own)], "g int, i int, v long")
    for code in (codecs.elias_fano_encode(df, "g", "i", "v"),):
        got = sorted((x.g, x.i, x.value) for x in codecs.elias_fano_decode(code, "g").collect())
        assert got == [(g, i, v) for g, own in groups.items() for i, v in enumerate(own)]
    parts = codecs.elias_fano_blocks(df, "g", "i", "v", block=16).collect()
    whole = {x.g: x for x in codecs.elias_fano_encode(df, "g", "i", "v").collect()}
    assert max(x.upper.count("1") for x in parts) == 16
    for g in groups:
        own = sorted((x for x in parts if x.g == g), key=lambda x: x.block)
        assert ("".join(x.upper for x in own), "".join(x.lower for x in own)) == (whole[g].upper, whole[g].lower)


def test_nearest_power(spark):
    got = spark.range(0, 300).select("id", codecs.log2_approx(F.col("id")).alias("x"), codecs.log2_approx(F.lit(1 << 61)).alias("top")).collect()
    assert all(x.x == ((3 * x.id).bit_length() - 2 if x.id else -1) and x.top == 61 for x in got)


def test_streams_are_packed(spark):
    for fixed, unary in (("", "1"), ("0110", "00101"), ("1" * 17, "0" * 30 + "1")):
        made = recsplit.pack(fixed, unary)
        assert recsplit.unpack(made) == (fixed, unary) and len(made["fixed"]) == -(-len(fixed) // 8)
    assert dict(catalogue.built_recsplit(catalogue.suppliers(spark, DIR))[1].dtypes)["unary"] == "binary"


def test_many_buckets_of_sichash_are_reached(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    plan = sichash.Plan(bucket_size=1)
    assert plan.buckets(200_000) == 200_000
    got = sichash.with_class(keys, plan, plan.buckets(200_000)).agg(F.countDistinct("bucket").alias("n"), F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).first()
    assert got.n > 18_500 and 0 <= got.lo and 1 << 16 < got.hi < 200_000


@pytest.mark.parametrize("form", ["plain", "bipartite", "trees"])
def test_space_of_shockhash(spark, form):
    got = [x for x in catalogue.space_shockhash(spark, DIR).collect() if x.form == form]
    assert all(x.bits >= 0 for x in got) and 1 < got[0].bits_per_key < 12 and sum(x.bits for x in got) == got[0].total_bits
