"""Static retrieval: small values by key without the keys, as banded linear systems over GF(2)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import combine64, fast_range64, fmix64, murmur128_of
from .grouped import by_group, by_group_with

BAND = 64
KEY_SEED = 1203
U64 = np.uint64
ONE, TOP = U64(1), U64(1 << 63)


def rows_of(h: np.ndarray, seed: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, coefficients) of each key hash in a system of m columns; the first coefficient (the top bit) is one."""
    x = fmix64(h + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)))
    start = (x >> U64(32)) * U64(m - BAND + 1) >> U64(32)
    return start.astype(np.int64), fmix64(x ^ U64(0xD6E8FEB86659FD93)) | TOP


class System:
    """A banded system in echelon form: row p has its leading one in column p."""

    def __init__(self, m: int):
        self.m, self.rows, self.values = m, [0] * m, [0] * m

    def insert(self, start: int, row: int, value: int) -> int:
        """The column that the row leads, -1 if it says nothing new, -2 if it contradicts what is there."""
        while row:
            shift = 64 - row.bit_length()
            row, start = (row << shift) & (2**64 - 1), start + shift
            if not self.rows[start]:
                self.rows[start], self.values[start] = row, value
                return start
            row, value = row ^ self.rows[start], value ^ self.values[start]
        return -1 if value == 0 else -2

    def clear(self, p: int) -> None:
        self.rows[p] = self.values[p] = 0

    def solve(self, bits: int) -> np.ndarray:
        """Bit-sliced solution: one run of words for each value bit, the first column in the top bit."""
        words = -(-self.m // 64) + 1
        out = np.zeros((bits, words), U64)
        for bit in range(bits):
            z = [0] * (self.m + 64)
            window = 0
            for p in range(self.m - 1, -1, -1):
                window >>= 1
                if self.rows[p]:
                    odd = ((self.rows[p] & window).bit_count() ^ (self.values[p] >> bit)) & 1
                    if odd:
                        window |= 1 << 63
                        z[p] = 1
            packed = np.packbits(np.array(z[: words * 64] + [0] * max(0, words * 64 - len(z)), np.uint8))
            out[bit] = packed.view(">u8").astype(U64)
        return out


def read_values(z: np.ndarray, start: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Per value bit the parity of the solution's window under the row."""
    word, off = start // 64, (start % 64).astype(U64)
    out = np.zeros(len(start), np.int64)
    for bit in range(len(z)):
        high = z[bit][word] << off
        low = np.where(off == 0, U64(0), z[bit][np.minimum(word + 1, z.shape[1] - 1)] >> np.where(off == 0, U64(1), U64(64) - off))
        out |= (np.bitwise_count((high | low) & row) & 1).astype(np.int64) << bit
    return out


def build_ribbon(h: np.ndarray, values: np.ndarray, bits: int, epsilon: float = 0.05, first_seed: int = 0) -> dict:
    """One system for all keys, of (1 + epsilon) n columns and at least 65; seeds are tried from the first, each from
    an empty table, until no row contradicts. Equal hashes with unequal values can't be told apart: ValueError."""
    m = max(BAND + 1, math.floor((1 + epsilon) * len(h)) + 1)
    for seed in range(first_seed, first_seed + 200):
        start, row = rows_of(h, seed, m)
        system = System(m)
        if all(system.insert(s, r, v) != -2 for s, r, v in sorted(zip(start.tolist(), row.tolist(), values.tolist()))):
            return {"m": m, "seed": seed, "z": system.solve(bits)}
        m += max(1, m // 50)
    raise ValueError("no seed gives a consistent system: are there equal keys with unequal values?")


def thresholds(b: int, epsilon: float) -> list[int]:
    """Offsets in a bucket up to which keys are bumped, by its two bits of metadata (0: none)."""
    return [-1, math.ceil((0.09 - 0.75 * epsilon) * b), math.ceil((0.22 - 1.3 * epsilon) * b), b - 1]


def build_layer(h: np.ndarray, values: np.ndarray, bits: int, b: int, epsilon: float, seed: int) -> tuple[dict, np.ndarray]:
    """A bumping layer and the mask of keys that it leaves to the next one.

    Keys go in bucket by bucket, from the highest start down. Where one contradicts, the smallest threshold at or above
    its offset is taken: keys at or below it are bumped, and rows that they had led are cleared (they came last, so no
    other row depends on them)."""
    m = max(BAND + 1, math.floor((1 + epsilon) * len(h)) + 1)
    start, row = rows_of(h, seed, m)
    system, cut, meta = System(m), thresholds(b, epsilon), np.zeros(-(-m // b), np.uint8)
    bumped = np.zeros(len(h), bool)
    order = np.lexsort((row, -start, start // b))
    place, coefficient, value = start.tolist(), row.tolist(), values.tolist()
    lo = 0
    while lo < len(order):
        bucket, hi = place[order[lo]] // b, lo
        while hi < len(order) and place[order[hi]] // b == bucket:
            hi += 1
        led: list[tuple[int, int]] = []
        for i in order[lo:hi]:
            p = system.insert(place[i], coefficient[i], value[i])
            if p == -2:
                level = next(t for t in (1, 2, 3) if cut[t] >= place[i] - bucket * b)
                meta[bucket] = level
                for offset, q in led:
                    if offset <= cut[level] and q >= 0:
                        system.clear(q)
                for j in order[lo:hi]:
                    bumped[j] = place[j] - bucket * b <= cut[level]
                break
            led.append((place[i] - bucket * b, p))
        lo = hi
    return {"m": m, "seed": seed, "z": system.solve(bits), "meta": meta}, bumped


def build_bumped(h: np.ndarray, values: np.ndarray, bits: int, b: int = 64, epsilon: float = 0.0, layers: int = 4) -> list[dict]:
    """layers - 1 bumping layers, then one system with slack for what is left; seeds 7, 8, 9, ..."""
    out = []
    for k in range(layers - 1):
        layer, bumped = build_layer(h, values, bits, b, epsilon, 7 + k)
        out.append(layer)
        h, values = h[bumped], values[bumped]
    return [*out, build_ribbon(h, values, bits, 0.1, 7 + layers - 1)]


def query_bumped(layers: list[dict], h: np.ndarray, b: int = 64, epsilon: float = 0.0) -> np.ndarray:
    out, left, cut = np.zeros(len(h), np.int64), np.arange(len(h)), np.array(thresholds(b, epsilon))
    for layer in layers:
        start, row = rows_of(h[left], layer["seed"], layer["m"])
        here = np.ones(len(left), bool)
        if len(layer.get("meta", ())):
            here = start % b > cut[layer["meta"][start // b]]
        out[left[here]] = read_values(layer["z"], start[here], row[here])
        left = left[~here]
    return out


ARTIFACT = "shard long, layer int, m int, seed int, bits int, z binary, meta binary"


def with_key_hash(keys: DataFrame, key: str = "key") -> DataFrame:
    """Adds kh, the 64-bit hash that rows derive from, and ks, an independent one for sharding."""
    both = keys.withColumn("_h", murmur128_of(F.col(key), KEY_SEED))
    return both.withColumn("kh", F.col("_h.h1")).withColumn("ks", F.col("_h.h2")).drop("_h")


def n_shards(n: int, per_shard: int) -> int:
    return max(1, -(-n // per_shard))


def build_retrieval(pairs: DataFrame, bits: int, shards: int, method: str = "bumped", b: int = 64, epsilon: float | None = None, layers: int = 4) -> DataFrame:
    """Artifact rows for pairs (key, value below 2^bits) of distinct keys; shards are independent systems.

    method "ribbon" solves one system a shard (epsilon 0.25), "bumped" layers with bumping (epsilon 0). A shard is one
    shuffle group, so `shards` sets the memory of a task; every key's shard comes from a hash of its own.
    """
    epsilon = {"ribbon": 0.25, "bumped": 0.0}[method] if epsilon is None else epsilon
    placed = with_key_hash(pairs).select(fast_range64(F.col("ks"), shards).alias("shard"), "kh", F.col("value").cast("int").alias("value"))

    def kernel(group: pa.Table) -> dict[str, list]:
        h, v = group.column("kh").to_numpy().view(U64), group.column("value").to_numpy()
        made = [build_ribbon(h, v, bits, epsilon)] if method == "ribbon" else build_bumped(h, v, bits, b, epsilon, layers)
        n = len(made)
        return {"shard": [group.column("shard")[0].as_py()] * n, "layer": list(range(n)), "m": [x["m"] for x in made], "seed": [x["seed"] for x in made], "bits": [bits] * n, "z": [x["z"].tobytes() for x in made], "meta": [x.get("meta", np.empty(0, np.uint8)).tobytes() for x in made]}

    return by_group(placed, "shard", ["kh"], kernel, ARTIFACT)


def open_layers(rows: list[dict]) -> list[dict]:
    """Artifact rows of one shard, ready for query_bumped()."""
    return [{"m": r["m"], "seed": r["seed"], "z": np.frombuffer(r["z"], U64).reshape(r["bits"], -1), "meta": np.frombuffer(r["meta"], np.uint8)} for r in sorted(rows, key=lambda r: r["layer"])]


def retrieve(keys: DataFrame, artifact: DataFrame, shards: int, b: int = 64, epsilon: float = 0.0) -> DataFrame:
    """keys (key, ...) with their value. A key that wasn't built in gets some value below 2^bits.

    Keys meet their shard's layers in one shuffle on the shard.
    """
    placed = with_key_hash(keys).withColumn("shard", fast_range64(F.col("ks"), shards)).select(*keys.columns, "kh", "shard")
    names, schema = keys.columns, f"{keys.select(*keys.columns)._jdf.schema().toDDL()}, value int"

    def kernel(group: pa.Table, layers: list[dict]) -> dict[str, list]:
        made = open_layers(layers)
        values = query_bumped(made, group.column("kh").to_numpy().view(U64), b, epsilon)
        return {**{n: group.column(n).to_pylist() for n in names}, "value": values.tolist()}

    return by_group_with(placed, artifact, "shard", kernel, schema)


def retrieval_space(artifact: DataFrame) -> DataFrame:
    """Bits a layer: the solution's, and two a bucket of metadata."""
    return artifact.groupBy("layer").agg(F.sum(F.octet_length("z") * 8 + F.octet_length("meta") * 2).cast("long").alias("bits"))
