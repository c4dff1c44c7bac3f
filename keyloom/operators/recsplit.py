"""RecSplit: minimal perfect hashing by recursive splitting, one small tree a bucket."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import GOLDEN
from ..functions.hashing import fast_range64, fmix64, murmur128_of
from .grouped import by_group, by_group_with
from .prefix import exclusive_prefix

U64 = np.uint64
STEP = U64(0x9E3779B97F4A7C15)
#: Seeds tried at once, and the most tried before a set of keys is taken to hold two with equal hashes.
BLOCK, MOST = 256, 1 << 34


@dataclass(frozen=True)
class Plan:
    bucket_size: int = 100
    leaf: int = 8
    bucket_seed: int = 42

    def buckets(self, n: int) -> int:
        return max(1, -(-n // self.bucket_size))


def fanout(size: int, leaf: int) -> list[int]:
    """Sizes of the parts that a set of `size` keys is split into."""
    if size <= leaf:
        return [size]
    lower = leaf * max(2, math.ceil(0.35 * leaf + 0.5))
    upper = lower * (math.ceil(0.21 * leaf + 0.9) if leaf >= 7 else 2)
    if size > upper:
        first = upper * ((size // 2 + upper - 1) // upper)
        return [first, size - first]
    part = lower if size > lower else leaf
    return [part] * (size // part) + ([size % part] if size % part else [])


def _parameter(p: float) -> int:
    return 0 if p >= 1 else max(0, math.ceil(math.log2(-math.log(GOLDEN) / math.log1p(-p))))


@lru_cache(maxsize=None)
def parameter(size: int, leaf: int, paired: bool = False) -> int:
    """Golomb-Rice parameter of a node's seed: by the trials that a bijection or a split is expected to take. With
    paired leaves a key has two slots to choose from, which takes about (e / 2)^size trials."""
    parts = fanout(size, leaf)
    if len(parts) == 1 and paired:
        return _parameter((2 / math.e) ** size) if size > 1 else 0
    if len(parts) == 1:
        return _parameter(math.sqrt(2 * math.pi * size) / math.exp(size)) if size > 1 else 0
    return _parameter(1 / math.sqrt((2 * math.pi) ** (len(parts) - 1) * math.prod(parts) / sum(parts)))


@lru_cache(maxsize=None)
def subtree(size: int, leaf: int, paired: bool = False) -> tuple[int, int]:
    """(nodes, fixed bits) of the tree of a set: sizes 0 and 1 have no node."""
    if size < 2:
        return 0, 0
    parts = fanout(size, leaf)
    if len(parts) == 1:
        return 1, parameter(size, leaf, paired)
    inner = [subtree(p, leaf, paired) for p in parts]
    return 1 + sum(n for n, _ in inner), parameter(size, leaf) + sum(b for _, b in inner)


def place(h1: np.ndarray, h2: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """A value below n for every seed (rows) and key (columns)."""
    x = fmix64(h1[None, :] + seeds[:, None].astype(U64) * STEP) ^ h2[None, :]
    return ((x >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def _search(h1: np.ndarray, h2: np.ndarray, n: int, good) -> int:
    """The smallest seed for which good(values) holds; blocks of seeds grow as the search goes on."""
    lo, block = 0, 16
    while lo < MOST:
        found = np.flatnonzero(good(place(h1, h2, np.arange(lo, lo + block, dtype=np.int64), n)))
        if len(found):
            return lo + int(found[0])
        lo, block = lo + block, min(2 * block, max(16, BLOCK * 64 // max(1, len(h1))))
    raise ValueError("two keys of a bucket have equal hashes: are keys distinct?")


def bijection(h1: np.ndarray, h2: np.ndarray) -> int:
    full = (1 << len(h1)) - 1
    return _search(h1, h2, len(h1), lambda v: np.bitwise_or.reduce(np.int64(1) << v, axis=1) == full)


def split(h1: np.ndarray, h2: np.ndarray, leaf: int, at_leaf=bijection) -> list[tuple[int, int]]:
    """Seeds of a set's tree in preorder, each with the size of its node; at_leaf finds the seed of a leaf."""
    size = len(h1)
    if size < 2:
        return []
    parts = fanout(size, leaf)
    if len(parts) == 1:
        return [(at_leaf(h1, h2), size)]
    cuts = np.cumsum(parts)
    low = np.concatenate([[0], cuts[:-1]])

    def exact(v: np.ndarray) -> np.ndarray:
        ok = np.ones(len(v), bool)
        for a, b, p in zip(low, cuts, parts):
            ok &= ((v >= a) & (v < b)).sum(1) == p
        return ok

    seed = _search(h1, h2, size, exact)
    part = np.searchsorted(cuts, place(h1, h2, np.array([seed]), size)[0], "right")
    out = [(seed, size)]
    for k in range(len(parts)):
        out += split(h1[part == k], h2[part == k], leaf, at_leaf)
    return out


def encode(nodes: list[tuple[int, int]], leaf: int, paired: bool = False) -> tuple[str, str]:
    """Fixed and unary Golomb-Rice streams of a tree's seeds."""
    fixed, unary = [], []
    for seed, size in nodes:
        r = parameter(size, leaf, paired)
        fixed.append(format(seed & ((1 << r) - 1), f"0{r}b") if r else "")
        unary.append("0" * (seed >> r) + "1")
    return "".join(fixed), "".join(unary)


STREAMS = "fixed binary, fixed_bits int, unary binary, unary_bits int"


def pack(fixed: str, unary: str) -> dict[str, bytes | int]:
    """Streams as an artifact keeps them: eight bits a byte, and their numbers."""
    data = lambda bits: np.packbits(np.frombuffer(bits.encode(), np.uint8) & 1).tobytes()
    return {"fixed": data(fixed), "fixed_bits": len(fixed), "unary": data(unary), "unary_bits": len(unary)}


def unpack(row: dict) -> tuple[str, str]:
    bits = lambda data, n: (np.unpackbits(np.frombuffer(data, np.uint8), count=n) + ord("0")).tobytes().decode()
    return bits(row["fixed"], row["fixed_bits"]), bits(row["unary"], row["unary_bits"])


class Tree:
    """A bucket's tree read from its streams; a sibling's subtree is skipped by its number of nodes and fixed bits."""

    def __init__(self, fixed: str, unary: str, leaf: int, paired: bool = False):
        self.fixed, self.leaf, self.paired = fixed, leaf, paired
        self.ends = np.flatnonzero(np.frombuffer(unary.encode(), np.uint8) == ord("1"))

    def seed(self, node: int, bit: int, size: int) -> int:
        r = parameter(size, self.leaf, self.paired)
        quotient = int(self.ends[node] - (self.ends[node - 1] + 1 if node else 0))
        return (quotient << r) | (int(self.fixed[bit : bit + r], 2) if r else 0)

    def values(self, h1: np.ndarray, h2: np.ndarray, size: int, choice: np.ndarray | None = None, node: int = 0, bit: int = 0) -> np.ndarray:
        """Values below size of keys (members get distinct ones); with paired leaves, by each key's choice."""
        if size < 2 or not len(h1):
            return np.zeros(len(h1), np.int64)
        seed, parts = self.seed(node, bit, size), fanout(size, self.leaf)
        if len(parts) == 1 and self.paired:
            both = place(h1, h2, np.array([2 * seed, 2 * seed + 1]), size)
            return np.where(choice == 0, both[0], both[1])
        got = place(h1, h2, np.array([seed]), size)[0]
        if len(parts) == 1:
            return got
        cuts, out = np.cumsum(parts), np.empty(len(h1), np.int64)
        part = np.searchsorted(cuts, got, "right")
        node, bit = node + 1, bit + parameter(size, self.leaf)
        for k, p in enumerate(parts):
            here = part == k
            if here.any():
                out[here] = cuts[k] - p + self.values(h1[here], h2[here], p, None if choice is None else choice[here], node, bit)
            nodes, bits = subtree(p, self.leaf, self.paired)
            node, bit = node + nodes, bit + bits
        return out


def with_bucket(keys: DataFrame, plan: Plan, buckets: int) -> DataFrame:
    """Adds bucket, h1 and h2 to a table with a column key."""
    return keys.withColumn("_h", murmur128_of(F.col("key"), plan.bucket_seed)).select(*keys.columns, fast_range64(F.col("_h.h2"), buckets).alias("bucket"), F.col("_h.h1").alias("h1"), F.col("_h.h2").alias("h2"))


def _hashes(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return group.column("h1").to_numpy().view(U64), group.column("h2").to_numpy().view(U64)


def build(keys: DataFrame, plan: Plan, n: int) -> DataFrame:
    """The artifact for n distinct non-null keys: bucket, size, both streams and their bits, size_before (a row a bucket
    with keys).

    One shuffle, on the bucket; a bucket's keys (about bucket_size) are the largest thing in a worker."""

    def kernel(group: pa.Table) -> dict[str, list]:
        h1, h2 = _hashes(group)
        streams = pack(*encode(split(h1, h2, plan.leaf), plan.leaf))
        return {"bucket": [group.column("bucket")[0].as_py()], "size": [len(h1)], **{n: [v] for n, v in streams.items()}}

    trees = by_group(with_bucket(keys, plan, plan.buckets(n)).select("bucket", "h1", "h2"), "bucket", ["h1", "h2"], kernel, f"bucket long, size long, {STREAMS}")
    return exclusive_prefix(trees, "bucket", ["size"])


def lookup(keys: DataFrame, artifact: DataFrame, plan: Plan, n: int) -> DataFrame:
    """keys (key, ...) with mph in [0, n): distinct for the keys that were built in. Others get some value in range, or
    none if their bucket had no keys."""
    names = keys.columns
    schema = f"{keys._jdf.schema().toDDL()}, mph long"

    def kernel(group: pa.Table, trees: list[dict]) -> dict[str, list]:
        h1, h2 = _hashes(group)
        one = trees[0]
        got = Tree(*unpack(one), plan.leaf).values(h1, h2, one["size"]) + one["size_before"]
        return {**{c: group.column(c).to_pylist() for c in names}, "mph": got.tolist()}

    return by_group_with(with_bucket(keys, plan, plan.buckets(n)), artifact, "bucket", kernel, schema)


def nodes(keys: DataFrame, plan: Plan, n: int) -> DataFrame:
    """The splitting trees as rows: bucket, preorder, size, seed, is_leaf."""

    def kernel(group: pa.Table) -> dict[str, list]:
        got = split(*_hashes(group), plan.leaf)
        return {"bucket": [group.column("bucket")[0].as_py()] * len(got), "preorder": list(range(len(got))), "size": [s for _, s in got], "seed": [x for x, _ in got], "is_leaf": [s <= plan.leaf for _, s in got]}

    return by_group(with_bucket(keys, plan, plan.buckets(n)).select("bucket", "h1", "h2"), "bucket", ["h1", "h2"], kernel, "bucket long, preorder int, size int, seed long, is_leaf boolean")


def fanout_table(spark: SparkSession, sizes: list[int], leaves: list[int]) -> DataFrame:
    """fanout() as expressions over a table of sizes and leaf sizes: size, leaf, parts."""
    grid = spark.createDataFrame([(s, m) for s in sizes for m in leaves], "size int, leaf int")
    size, leaf = F.col("size"), F.col("leaf")
    lower = (leaf * F.greatest(F.lit(2), F.ceil(0.35 * leaf + 0.5))).cast("int")
    upper = (F.col("lower") * F.when(leaf >= 7, F.ceil(0.21 * leaf + 0.9)).otherwise(2)).cast("int")
    half = (F.col("upper") * F.floor((F.floor(size / 2) + F.col("upper") - 1) / F.col("upper"))).cast("int")
    part = F.when(size > F.col("lower"), F.col("lower")).otherwise(leaf)
    rest = (size % part).cast("int")
    even = F.array_repeat(part, F.floor(size / part).cast("int"))
    parts = F.when(size <= leaf, F.array(size)).when(size > F.col("upper"), F.array(half, size - half)).when(rest > 0, F.concat(even, F.array(rest))).otherwise(even)
    return grid.withColumn("lower", lower).withColumn("upper", upper).select("size", "leaf", parts.alias("parts"))


def subtree_table(spark: SparkSession, most: int, leaf: int) -> DataFrame:
    """size, param, nodes, fixed_bits for every size from 1 to most (at most a bucket): a small table to broadcast."""
    return spark.createDataFrame([(s, parameter(s, leaf), *subtree(s, leaf)) for s in range(1, most + 1)], "size int, param int, nodes int, fixed_bits int")


def space(artifact: DataFrame) -> DataFrame:
    """Bits by component: both seed streams, and Elias-Fano codes of the prefixes of keys and of the two streams."""
    sums = artifact.agg(F.count("*").alias("n"), F.sum("size").alias("keys"), F.sum("fixed_bits").alias("fixed"), F.sum("unary_bits").alias("unary")).collect()[0]

    def code(n: int, top: int) -> int:
        low = max(0, (-(-top // n) - 1).bit_length()) if n else 0
        return n * low + n + (top >> low)

    rows = [("fixed", sums.fixed or 0), ("unary", sums.unary or 0), *((f"prefix_{c}", code(sums.n, sums[c] or 0)) for c in ("keys", "fixed", "unary"))]
    return artifact.sparkSession.createDataFrame(rows, "component string, bits long")
