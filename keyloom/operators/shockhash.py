"""ShockHash: minimal perfect hashing with two candidate slots a key and exactly as many slots as keys."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import elias_fano_space, low_bits
from ..functions.hashing import fmix64, mod_range128, murmur128_of
from .grouped import by_group, by_group_with
from .prefix import exclusive_prefix
from .recsplit import MOST, STEP, place
from .retrieval import build_retrieval, n_shards, retrieval_space, retrieve

U64 = np.uint64
KEYS_PER_SHARD = 4096
#: Slots are tracked in the bits of a long.
MOST_KEYS = 62


@dataclass(frozen=True)
class Plan:
    bucket_size: int = 20
    bipartite: bool = False
    bucket_seed: int = 42

    def buckets(self, n: int) -> int:
        return max(1, -(-n // self.bucket_size))


def orient(a: list[int], b: list[int], n: int) -> list[int] | None:
    """Which of its two slots each of n keys takes so that all differ, or None. Slots that only one key can still take
    are filled first; what is left are cycles, which are walked round. It fails just if some part has fewer slots than
    keys, which shows as a slot that no key wants."""
    near: list[set[int]] = [set() for _ in range(n)]
    for k in range(len(a)):
        near[a[k]].add(k)
        near[b[k]].add(k)
    choice, todo = [-1] * len(a), [s for s in range(n) if len(near[s]) == 1]

    def take(k: int, slot: int) -> None:
        choice[k] = 0 if a[k] == slot else 1
        for s in {a[k], b[k]}:
            near[s].discard(k)
        other = b[k] if a[k] == slot else a[k]
        if other != slot and len(near[other]) == 1:
            todo.append(other)

    filled = [False] * n
    for start in range(n + 1):
        while todo:
            s = todo.pop()
            if not filled[s] and near[s]:
                filled[s] = True
                take(next(iter(near[s])), s)
        if start < n and not filled[start] and near[start]:
            filled[start] = True
            take(min(near[start]), start)
    return choice if all(filled) else None


def covers(values: np.ndarray, n: int) -> np.ndarray:
    """For every row, whether its values hit all of 0 to n - 1."""
    return np.bitwise_or.reduce(np.int64(1) << values, axis=1) == (1 << n) - 1


def solve_plain(h1: np.ndarray, h2: np.ndarray) -> tuple[int, int, list[int]]:
    """The smallest seed whose two slots a key can be oriented, given twice, and the choices. Seeds whose candidate
    slots miss a slot are passed over at once."""
    n, lo = len(h1), 0
    while lo < MOST:
        seeds = np.arange(lo, lo + 256, dtype=np.int64)
        one, two = place(h1, h2, 2 * seeds, n), place(h1, h2, 2 * seeds + 1, n)
        for i in np.flatnonzero(covers(np.hstack([one, two]), n)):
            choice = orient(one[i].tolist(), two[i].tolist(), n)
            if choice:
                return int(seeds[i]), int(seeds[i]), choice
        lo += 256
    raise ValueError("no seed places the bucket: are keys distinct?")


def solve_bipartite(h1: np.ndarray, h2: np.ndarray) -> tuple[int, int, list[int]]:
    """Two seeds, one for the first half of the slots (rounded up) and one for the second. Only seeds whose values cover
    their half are kept; the newest is tried against all before it."""
    n = len(h1)
    halves, lo = (n - n // 2, n // 2), 0
    kept: list[list[tuple[int, list[int]]]] = [[], []]
    while lo < MOST:
        for seed in range(lo, lo + 64):
            new = []
            for side in (0, 1):
                v = place(h1, h2, np.array([2 * seed + side]), max(1, halves[side]))
                if not halves[side] or covers(v, halves[side])[0]:
                    new.append((side, (seed, [x + side * halves[0] for x in v[0].tolist()])))
            for side, made in new:
                for other in kept[1 - side]:
                    first, second = (made, other) if side == 0 else (other, made)
                    choice = orient(first[1], second[1] if halves[1] else first[1], n)
                    if choice:
                        return first[0], second[0], choice
                kept[side].append(made)
        lo += 64
    raise ValueError("no pair of seeds places the bucket: are keys distinct?")


@dataclass
class ShockHash:
    plan: Plan
    n: int
    buckets: DataFrame
    choices: DataFrame
    shards: int


def with_bucket(keys: DataFrame, plan: Plan, buckets: int) -> DataFrame:
    return keys.withColumn("_h", murmur128_of(F.col("key"), plan.bucket_seed)).select(*keys.columns, mod_range128(F.col("_h.h1"), F.col("_h.h2"), F.lit(buckets).cast("long")).alias("bucket"), F.col("_h.h1").alias("h1"), F.col("_h.h2").alias("h2"))


def build(keys: DataFrame, plan: Plan, n: int, persist=lambda df, name: df.cache()) -> ShockHash:
    """Build over n distinct non-null keys (one column, key). Buckets of more than MOST_KEYS keys are refused: choose a
    bucket_size well below it."""

    def kernel(group: pa.Table) -> dict[str, list]:
        h1, h2 = (group.column(c).to_numpy().view(U64) for c in ("h1", "h2"))
        if len(h1) > MOST_KEYS:
            raise ValueError(f"a bucket has {len(h1)} keys, more than {MOST_KEYS}")
        seed, second, choice = (solve_bipartite if plan.bipartite else solve_plain)(h1, h2)
        size = len(h1)
        return {"bucket": group.column("bucket").to_pylist(), "key": group.column("key").to_pylist(), "size": [size] * size, "seed": [seed] * size, "second": [second] * size, "choice": choice}

    placed = with_bucket(keys.select("key"), plan, plan.buckets(n))
    full = persist(by_group(placed, "bucket", ["h1", "h2"], kernel, "bucket long, key string, size long, seed long, second long, choice int"), "shockhash-placed")
    buckets = persist(exclusive_prefix(full.groupBy("bucket").agg(F.first("size").alias("size"), F.first("seed").alias("seed"), F.first("second").alias("second")), "bucket", ["size"]), "shockhash-buckets")
    shards = n_shards(n, KEYS_PER_SHARD)
    return ShockHash(plan, n, buckets, persist(build_retrieval(full.select("key", F.col("choice").alias("value")), 1, shards), "shockhash-choices"), shards)


def lookup(keys: DataFrame, built: ShockHash) -> DataFrame:
    """keys (key) with mph in [0, n), distinct for the keys that were built in."""
    plan = built.plan
    chosen = retrieve(with_bucket(keys.select("key"), plan, plan.buckets(built.n)), built.choices, built.shards)

    def kernel(group: pa.Table, own: list[dict]) -> dict[str, list]:
        h1, h2 = (group.column(c).to_numpy().view(U64) for c in ("h1", "h2"))
        choice, size = group.column("value").to_numpy().astype(np.int64), own[0]["size"]
        seed = np.where(choice == 0, own[0]["seed"], own[0]["second"])
        half = size - size // 2
        width, first = (np.where(choice == 0, half, max(1, size // 2)), np.where(choice == 0, 0, half)) if plan.bipartite else (np.full(len(h1), size), 0)
        x = fmix64(h1 + (2 * seed + choice).astype(U64) * STEP) ^ h2
        slot = ((x >> U64(32)) * width.astype(U64) >> U64(32)).astype(np.int64) + first
        return {"key": group.column("key").to_pylist(), "mph": (slot + own[0]["size_before"]).tolist()}

    return by_group_with(chosen, built.buckets, "bucket", kernel, "key string, mph long")


def space(built: ShockHash) -> DataFrame:
    """Bits by component: seeds (of a bipartite bucket, both) as Elias gamma codes, the one-bit choices' retrieval
    structure, and the Elias-Fano code of the prefixes of bucket sizes."""
    gamma = lambda c: 2 * (F.length(F.bin(F.col(c) + 1)) - 1) + 1
    seeds = gamma("seed") + gamma("second") if built.plan.bipartite else gamma("seed")
    sums = built.buckets.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("top"), F.coalesce(F.sum(seeds), F.lit(0)).alias("seeds"))
    parts = sums.withColumn("prefix", elias_fano_space(F.col("n"), F.col("top"), low_bits(F.col("n"), F.col("top"))))
    parts = parts.select(F.expr("stack(2, 'seeds', seeds, 'prefix', prefix) AS (component, bits)"))
    choices = retrieval_space(built.choices).agg(F.coalesce(F.sum("bits"), F.lit(0)).cast("long").alias("bits"))
    return parts.unionByName(choices.select(F.lit("choices").alias("component"), "bits"))
