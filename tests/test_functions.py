import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions import codecs, hashing

#: key, seed, 32-bit hash, h1, h2, 64-bit hash: published test values and an independent model's.
GOLDEN = [
    ("", 0, "0", "0", "0", "0"),
    ("", 1, "514e28b7", "4610abe56eff5cb5", "51622daa78f83583", "8b99628f52e032c1"),
    ("a", 42, "b2e5a263", "28259ca4fdf626b0", "25ebca9125f82b15", "4e11673623ee51c5"),
    ("hello", 0, "248bfa47", "cbd8a7b341bd9b02", "5b1e906a48ae1d19", "dd3458f21bc7f24d"),
    ("hello", 42, "e2dbd2e1", "c4b8b3c960af6f08", "2334b875b0efbc7a", "e7ed6c3f119f2b82"),
    ("hello, world", 0, "149bbb7f", "342fac623a5ebc8e", "4cdcbc079642414d", "810c6869d0a0fddb"),
    ("The quick brown fox jumps over the lazy dog", 0, "2e4ff723", "e34bbc7bbc071b6c", "7a433ca9c49a9347", "5215727909d6d541"),
]


def plain_murmur32(data: bytes, seed: int) -> int:
    m, h = 0xFFFFFFFF, seed
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    mix = lambda k: rot(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    end = len(data) // 4 * 4
    for i in range(0, end, 4):
        h = (rot(h ^ mix(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & m
    h ^= mix(int.from_bytes(data[end:], "little")) ^ len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & m
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & m
    return h ^ (h >> 16)


def test_golden_vectors():
    for key, seed, m32, h1, h2, m64 in GOLDEN:
        one, two = hashing.murmur128([key.encode()], seed)
        assert ["%x" % x for x in (hashing.murmur32([key.encode()], seed)[0], one[0], two[0], hashing.murmur64([key.encode()], seed)[0])] == [m32, h1, h2, m64]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=20), st.integers(0, 2**32 - 1))
def test_murmur32_matches_a_plain_one(keys, seed):
    assert hashing.murmur32(keys, seed).tolist() == [plain_murmur32(k, seed) for k in keys]


def test_seeds_of_their_own():
    keys = [b"a", b"bc", b"def", b"ghij"]
    assert hashing.murmur32(keys, np.array([1, 2, 3, 4])).tolist() == [plain_murmur32(k, s) for k, s in zip(keys, (1, 2, 3, 4))]


def test_ranges_are_exact(spark):
    values = [0, 1, 2**31, 2**63 - 1, 2**63, 2**64 - 1, 0x9E3779B97F4A7C15]
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "h long")
    for n in (1, 7, 1000, 2**31 - 1):
        got = df.select(hashing.fast_range64(F.col("h"), n), hashing.mod_range(F.col("h"), F.lit(n))).collect()
        assert [tuple(r) for r in got] == [(v * n >> 64, v % n) for v in values]
        wide = df.select(hashing.mod_range128(F.col("h"), F.col("h"), F.lit(n))).collect()
        assert [r[0] for r in wide] == [((v << 64) | v) % n for v in values]


def test_golomb_round_trip(spark):
    cases = [(v, r) for v in (0, 1, 2, 5, 7, 63, 1000, 5_678_901) for r in (1, 2, 5, 13, 20) if v >> r < 100_000] + [(3, 0)]
    df = spark.createDataFrame(cases, "v long, r int").withColumn("c", codecs.golomb_rice_encode(F.col("v"), F.col("r")))
    for v, r, fixed, unary, back in df.select("v", "r", "c.fixed", "c.unary", codecs.golomb_rice_decode(F.col("c.fixed"), F.col("c.unary"))).collect():
        assert (fixed, unary, back) == (format(v & ((1 << r) - 1), f"0{r}b") if r else "", "0" * (v >> r) + "1", v)


def test_golomb_parameters(spark):
    got = spark.range(1, 25).select(codecs.bijection_parameter(F.col("id"))).collect()
    assert [r[0] for r in got] == [0, 0, 1, 3, 4, 5, 7, 8, 10, 11, 12, 14, 15, 16, 18, 19, 21, 22, 23, 25, 26, 28, 29, 30]


def test_elias_fano_round_trip(spark):
    cases = {1: [2, 3, 5, 7, 11, 13, 24], 2: list(range(1234, 1244)), 3: [1, 1000], 4: [1234] * 10 + [1300], 5: [0]}
    df = spark.createDataFrame([(g, i, v) for g, vs in cases.items() for i, v in enumerate(vs)], "g int, i int, v long")
    code = codecs.elias_fano_encode(df, "g", "i", "v").cache()
    back = {g: [] for g in cases}
    for g, _, v in sorted(map(tuple, codecs.elias_fano_decode(code, "g").collect())):
        back[g].append(v)
    assert back == cases
    assert all(r.bits == len(r.upper) + len(r.lower) for r in code.filter("g < 5").select("*", codecs.elias_fano_space(F.col("n"), F.col("m"), F.col("l")).alias("bits")).collect())
    assert codecs.elias_fano_encode(df.filter("g > 9"), "g", "i", "v").count() == 0


def test_bit_strings(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, 2, 5, 255, 1 << 40)], "x long")
    got = df.select("x", codecs.bits_to_int(codecs.bits_lsb_first(F.col("x"))), codecs.highest_bit(F.col("x"))).collect()
    assert all(x == y and h == x.bit_length() - 1 for x, y, h in got)
