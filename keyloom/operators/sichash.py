"""SicHash: perfect hashing by cuckoo placement with 2, 4 or 8 choices a key; the choices go into retrieval structures."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import as_bytes, fast_range16, fast_range64, murmur32, murmur32_of, murmur128_of
from ..functions.shipping import ship
from .grouped import by_group
from .prefix import exclusive_prefix
from .retrieval import build_retrieval, n_shards, retrieval_space, retrieve

KEYS_PER_SHARD = 4096
U32_MAX = (1 << 32) - 1


@dataclass(frozen=True)
class Plan:
    bucket_size: int = 250
    p1: float = 0.49
    p2: float = 0.22
    alpha: float = 0.95
    bucket_seed: int = 42
    class_seed: int = 1

    def buckets(self, n: int) -> int:
        return max(1, -(-n // self.bucket_size))


def choice_bits(key: Column, plan: Plan) -> Column:
    """1, 2 or 3: log2 of a key's number of hash functions, from its hash as a share of 2^32 - 1."""
    u = murmur32_of(key, plan.class_seed) / F.lit(float(U32_MAX))
    return F.when(u < plan.p1, 1).when(u < plan.p1 + plan.p2, 2).otherwise(3)


def with_class(keys: DataFrame, plan: Plan, buckets: int) -> DataFrame:
    """Adds bits and bucket to a table with a column key. Up to 65,536 buckets, which is all that the 16-bit reduction
    reaches, come from a 32-bit hash; more from a 64-bit one."""
    key = F.col("key")
    few = buckets <= 1 << 16
    bucket = fast_range16(murmur32_of(key, plan.bucket_seed), buckets) if few else fast_range64(murmur128_of(key, plan.bucket_seed)["h2"], buckets)
    return keys.withColumn("bits", choice_bits(key, plan)).withColumn("bucket", bucket.cast("long"))


def bucket_table(placed: DataFrame, plan: Plan) -> DataFrame:
    """bucket, size, table_size and table_size_before of every bucket with keys."""
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("size")).withColumn("table_size", F.floor(F.col("size") / plan.alpha).cast("long"))
    return exclusive_prefix(sizes, "bucket", ["table_size"])


def rattle(slots: np.ndarray, hashes: np.ndarray, size: int) -> list[int] | None:
    """Each key's choice, or None. A key wants the slot of its counter; where two meet, the higher counter stays and the
    other counts on. Gives up on a key after 2 x size steps."""
    table, counter, want = [-1] * size, [0] * len(slots), slots.tolist()
    mask = (hashes - 1).tolist()
    for first in range(len(want)):
        key, steps = first, 0
        while True:
            slot = want[key][counter[key] & mask[key]]
            other = table[slot]
            if other < 0:
                table[slot] = key
                break
            if counter[key] > counter[other]:
                table[slot], key = key, other
            counter[key] += 1
            steps += 1
            if steps > 2 * size + 16:
                return None
    return [c & m for c, m in zip(counter, mask)]


def place_bucket(keys: list[bytes], hashes: np.ndarray, size: int) -> tuple[int, list[int], list[int]]:
    """The smallest seed under which all keys of a bucket find a slot, their choices and slots."""
    for seed in range(1 << 20):
        slots = np.stack([murmur32(keys, 8 * seed + c) for c in range(8)], 1) % np.uint32(size)
        got = rattle(slots, hashes, size)
        if got is not None:
            return seed, got, slots[np.arange(len(keys)), got].tolist()
    raise ValueError("no seed places the bucket: are keys distinct?")


@dataclass
class SicHash:
    plan: Plan
    n: int
    buckets: DataFrame
    choices: dict[int, DataFrame]
    shards: dict[int, int]
    remap: DataFrame
    placed: DataFrame


def build(keys: DataFrame, plan: Plan, n: int, persist=lambda df, name: df.cache()) -> SicHash:
    """Build over n distinct non-null keys (one column, key). `persist` keeps an intermediate table that several parts
    read (the placement and the artifact's own tables)."""

    def kernel(group: pa.Table) -> dict[str, list]:
        names = group.column("key").to_pylist()
        seed, choice, slot = place_bucket(as_bytes(names), 1 << group.column("bits").to_numpy().astype(np.int64), group.column("table_size")[0].as_py())
        first = group.column("table_size_before")[0].as_py()
        return {"bucket": group.column("bucket").to_pylist(), "key": names, "bits": group.column("bits").to_pylist(), "seed": [seed] * len(names), "choice": choice, "slot": [first + s for s in slot]}

    placed = persist(with_class(keys.select("key"), plan, plan.buckets(n)), "sichash-classes")
    sizes = bucket_table(placed, plan)
    full = persist(by_group(placed.join(sizes, "bucket"), "bucket", ["key"], kernel, "bucket long, key string, bits int, seed int, choice int, slot long"), "sichash-placed")
    buckets = persist(sizes.join(full.select("bucket", "seed").distinct(), "bucket"), "sichash-buckets")
    counts = {r.bits: r.n for r in full.groupBy("bits").agg(F.count("*").alias("n")).collect()}
    shards = {b: n_shards(counts.get(b, 0), KEYS_PER_SHARD) for b in (1, 2, 3)}
    choices = {b: persist(build_retrieval(full.filter(F.col("bits") == b).select("key", F.col("choice").alias("value")), b, shards[b]), f"sichash-choices-{b}") for b in (1, 2, 3)}
    return SicHash(plan, n, buckets, choices, shards, persist(make_minimal(full.select("slot"), n), "sichash-remap"), full)


def holes(slots: DataFrame, n: int) -> DataFrame:
    """Slots below n that no key has."""
    return slots.sparkSession.range(n).withColumnRenamed("id", "slot").join(slots.filter(F.col("slot") < n), "slot", "left_anti")


def make_minimal(slots: DataFrame, n: int) -> DataFrame:
    """(slot, hole): the k-th taken slot at or above n goes to the k-th hole below n."""
    rank = lambda df: exclusive_prefix(df.withColumn("one", F.lit(1).cast("long")), "slot", ["one"]).select("slot", F.col("one_before").alias("k"))
    return rank(slots.filter(F.col("slot") >= n)).join(rank(holes(slots, n)).withColumnRenamed("slot", "hole"), "k").select("slot", "hole")


def _slot(key: Column, seed: Column, size: Column) -> Column:
    def kernel(keys: pd.Series, seeds: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series((murmur32(as_bytes(keys), seeds.to_numpy()).astype(np.int64) % sizes.to_numpy()).astype(np.int64))

    return F.pandas_udf(kernel, "long")(key, seed, size)


def perfect(keys: DataFrame, built: SicHash) -> DataFrame:
    """keys (key) with a slot below the sum of table sizes, distinct for the keys that were built in."""
    ship(keys.sparkSession)
    placed = with_class(keys.select("key"), built.plan, built.plan.buckets(built.n))
    chosen = [retrieve(placed.filter(F.col("bits") == b).select("key", "bucket"), built.choices[b], built.shards[b]) for b in (1, 2, 3)]
    every = chosen[0].unionByName(chosen[1]).unionByName(chosen[2]).join(built.buckets, "bucket")
    return every.select("key", (F.col("table_size_before") + _slot(F.col("key"), (8 * F.col("seed") + F.col("value")).cast("long"), F.col("table_size"))).alias("slot"))


def lookup(keys: DataFrame, built: SicHash) -> DataFrame:
    """keys (key) with mph in [0, n)."""
    return perfect(keys, built).join(built.remap, "slot", "left").select("key", F.coalesce("hole", "slot").alias("mph"))


def by_index(keys: DataFrame, built: SicHash) -> DataFrame:
    """keys (key) with mph by an index of the placed keys instead of seeds and retrieval structures: what lookup() must
    give for keys that were built in."""
    own = keys.select("key").join(built.placed.select("key", "slot"), "key")
    return own.join(built.remap, "slot", "left").select("key", F.coalesce("hole", "slot").alias("mph"))


def space(built: SicHash) -> DataFrame:
    """Bits by component: the choices' retrieval structures, seeds, and Elias-Fano codes of prefixes and holes."""
    parts = None
    for b in (1, 2, 3):
        part = retrieval_space(built.choices[b]).agg(F.sum("bits").alias("bits")).select(F.lit(f"choices_{b}").alias("component"), F.coalesce("bits", F.lit(0)).cast("long").alias("bits"))
        parts = part if parts is None else parts.unionByName(part)
    seeds = built.buckets.select(F.lit("seeds").alias("component"), (2 * F.floor(F.log2(F.col("seed") + 1)) + 1).cast("long").alias("bits")).groupBy("component").agg(F.sum("bits").alias("bits"))
    code = lambda n, top: (n * F.greatest(F.ceil(F.log2(F.greatest(top / F.greatest(n, F.lit(1)), F.lit(1.0)))), F.lit(0)) + 2 * n).cast("long")
    prefix = built.buckets.agg(F.count("*").alias("n"), F.sum("table_size").alias("top")).select(F.lit("prefix").alias("component"), code(F.col("n"), F.col("top")).alias("bits"))
    gaps = built.remap.agg(F.count("*").alias("n")).select(F.lit("holes").alias("component"), code(F.col("n"), F.lit(built.n)).alias("bits"))
    return parts.unionByName(seeds).unionByName(prefix).unionByName(gaps)
