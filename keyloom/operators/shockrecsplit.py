"""ShockHash leaves inside RecSplit trees: larger leaves, and one stored choice bit a key."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import by_group, by_group_with
from .prefix import exclusive_prefix
from .recsplit import STREAMS, Plan, Tree, _hashes, encode, pack, split, unpack, with_bucket
from .recsplit import space as tree_space
from .retrieval import build_retrieval, n_shards, retrieval_space, retrieve
from .shockhash import KEYS_PER_SHARD, solve_plain


@dataclass
class ShockRecSplit:
    plan: Plan
    n: int
    trees: DataFrame
    choices: DataFrame
    shards: int


def split_paired(h1, h2, leaf: int) -> tuple[list[tuple[int, int]], list[int]]:
    """The tree's seeds and every key's choice (0 where its leaf has no node)."""
    chosen: dict[tuple[int, int], int] = {}

    def at_leaf(a, b) -> int:
        seed, _, choice = solve_plain(a, b)
        chosen.update(zip(zip(a.tolist(), b.tolist()), choice))
        return seed

    nodes = split(h1, h2, leaf, at_leaf)
    return nodes, [chosen.get(k, 0) for k in zip(h1.tolist(), h2.tolist())]


def build(keys: DataFrame, plan: Plan, n: int, persist=lambda df, name: df.cache()) -> ShockRecSplit:
    """Build over n distinct non-null keys (one column, key)."""

    def kernel(group: pa.Table) -> dict[str, list]:
        nodes, choice = split_paired(*_hashes(group), plan.leaf)
        streams = pack(*encode(nodes, plan.leaf, True))
        size = len(group)
        first = [True] + [False] * (size - 1)
        return {"bucket": group.column("bucket").to_pylist(), "key": group.column("key").to_pylist(), "value": choice, "first": first, "size": [size] * size, **{n: [v if f else None for f in first] for n, v in streams.items()}}

    schema = "bucket long, key string, value int, first boolean, size long, " + STREAMS
    full = persist(by_group(with_bucket(keys.select("key"), plan, plan.buckets(n)), "bucket", ["h1", "h2"], kernel, schema), "shockrecsplit")
    trees = persist(exclusive_prefix(full.filter("first").select("bucket", "size", "fixed", "fixed_bits", "unary", "unary_bits"), "bucket", ["size"]), "shockrecsplit-trees")
    shards = n_shards(n, KEYS_PER_SHARD)
    return ShockRecSplit(plan, n, trees, persist(build_retrieval(full.select("key", "value"), 1, shards), "shockrecsplit-choices"), shards)


def lookup(keys: DataFrame, built: ShockRecSplit) -> DataFrame:
    """keys (key) with mph in [0, n), distinct for the keys that were built in."""
    plan = built.plan
    chosen = retrieve(with_bucket(keys.select("key"), plan, plan.buckets(built.n)), built.choices, built.shards)

    def kernel(group: pa.Table, trees: list[dict]) -> dict[str, list]:
        one = trees[0]
        values = Tree(*unpack(one), plan.leaf, True).values(*_hashes(group), one["size"], group.column("value").to_numpy())
        return {"key": group.column("key").to_pylist(), "mph": (values + one["size_before"]).tolist()}

    return by_group_with(chosen, built.trees, "bucket", kernel, "key string, mph long")


def space(built: ShockRecSplit) -> DataFrame:
    """Bits by component: the trees' streams and prefixes, and the choices' retrieval structure."""
    choices = retrieval_space(built.choices).agg(F.coalesce(F.sum("bits"), F.lit(0)).cast("long").alias("bits"))
    return tree_space(built.trees).unionByName(choices.select(F.lit("choices").alias("component"), "bits"))
