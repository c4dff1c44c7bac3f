"""Seeded MurmurHash3 over byte strings, vectorised over keys, and reductions of hashes to ranges.

Unsigned results are carried in Spark as follows: 32-bit values as non-negative longs, 64-bit values as longs in two's
complement (hex64() prints them unsigned), 128-bit values as a struct (h1, h2) of such longs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .shipping import ship

U32, U64 = np.uint32, np.uint64

#: Fixed values of the published hash.
C1_32, C2_32, ADD_32 = U32(0xCC9E2D51), U32(0x1B873593), U32(0xE6546B64)
MIX_32 = (U32(0x85EBCA6B), U32(0xC2B2AE35))
C1_64, C2_64 = U64(0x87C37B91114253D5), U64(0x4CF5AD432745937F)
MIX_64 = (U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53))
ADD_64 = (U64(0x52DCE729), U64(0x38495AB5))


def rotl(x: np.ndarray, r: int) -> np.ndarray:
    bits = 8 * x.dtype.itemsize
    return (x << x.dtype.type(r)) | (x >> x.dtype.type(bits - r))


def fmix32(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U32(16))) * MIX_32[0]
    h = (h ^ (h >> U32(13))) * MIX_32[1]
    return h ^ (h >> U32(16))


def fmix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(33))) * MIX_64[0]
    h = (h ^ (h >> U64(33))) * MIX_64[1]
    return h ^ (h >> U64(33))


def as_bytes(keys) -> list[bytes]:
    return [k.encode() if isinstance(k, str) else bytes(k) for k in keys]


def _layout(keys: list[bytes], width: int, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys laid end to end, longest first, each padded with zeros to whole blocks: the order, lengths in that order,
    all words, and where each key's words start. So the keys that still have a block i are a leading run."""
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    padded = -(-lengths // width) * width
    data = b"".join([keys[i].ljust(p, b"\0") for i, p in zip(order.tolist(), padded.tolist())])
    words = np.frombuffer(data, dtype)
    return order, lengths, words, (np.cumsum(padded) - padded) // words.dtype.itemsize


def murmur32(keys: list[bytes], seeds) -> np.ndarray:
    """MurmurHash3_x86_32 with one seed or a seed for each key."""
    order, lengths, words, start = _layout(keys, 4, "<u4")
    mix = lambda k: rotl(k * C1_32, 15) * C2_32
    h = np.broadcast_to(np.asarray(seeds, np.int64).astype(U32), len(keys))[order].copy()
    full = lengths // 4
    for i in range(int(full.max(initial=0))):
        n = int(np.searchsorted(-full, -i))
        h[:n] = rotl(h[:n] ^ mix(words[start[:n] + i]), 13) * U32(5) + ADD_32
    tail = np.flatnonzero(lengths % 4)
    h[tail] ^= mix(words[start[tail] + full[tail]])
    out = np.empty(len(keys), U32)
    out[order] = fmix32(h ^ lengths.astype(U32))
    return out


def murmur128(keys: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """MurmurHash3_x64_128 as (h1, h2)."""
    order, lengths, words, start = _layout(keys, 16, "<u8")
    mix1 = lambda k: rotl(k * C1_64, 31) * C2_64
    mix2 = lambda k: rotl(k * C2_64, 33) * C1_64
    h1, h2 = np.full(len(keys), seed, U64), np.full(len(keys), seed, U64)
    full = lengths // 16
    for i in range(int(full.max(initial=0))):
        n = int(np.searchsorted(-full, -i))
        at = start[:n] + 2 * i
        h1[:n] = (rotl(h1[:n] ^ mix1(words[at]), 27) + h2[:n]) * U64(5) + ADD_64[0]
        h2[:n] = (rotl(h2[:n] ^ mix2(words[at + 1]), 31) + h1[:n]) * U64(5) + ADD_64[1]
    tail = np.flatnonzero(lengths % 16)
    at = start[tail] + 2 * full[tail]
    h1[tail] ^= mix1(words[at])
    h2[tail] ^= mix2(words[at + 1])
    h1, h2 = h1 ^ lengths.astype(U64), h2 ^ lengths.astype(U64)
    h1 = h1 + h2
    h2 = h2 + h1
    h1, h2 = fmix64(h1), fmix64(h2)
    h1 = h1 + h2
    h2 = h2 + h1
    out1, out2 = np.empty(len(keys), U64), np.empty(len(keys), U64)
    out1[order], out2[order] = h1, h2
    return out1, out2


def combine64(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """A 64-bit hash from both halves of the 128-bit one."""
    return h2 * ((fmix64(h1) & U64(3)) + U64(1)) + h1


def murmur64(keys: list[bytes], seed: int) -> np.ndarray:
    return combine64(*murmur128(keys, seed))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _udf(kernel: Callable, returns: str, key: Column) -> Column:
    from pyspark.sql import SparkSession

    ship(SparkSession.active())
    return F.pandas_udf(kernel, returns)(key)


def murmur32_of(key: Column, seed: int = 0) -> Column:
    """The 32-bit hash of a string or binary column, in 0 to 2^32 - 1. Null keys must be filtered first."""

    def kernel(keys: pd.Series) -> pd.Series:
        return pd.Series(murmur32(as_bytes(keys), seed).astype(np.int64))

    return _udf(kernel, "long", key)


def murmur128_of(key: Column, seed: int = 0) -> Column:
    """struct(h1, h2)."""

    def kernel(keys: pd.Series) -> pd.DataFrame:
        h1, h2 = murmur128(as_bytes(keys), seed)
        return pd.DataFrame({"h1": signed(h1), "h2": signed(h2)})

    return _udf(kernel, "h1 long, h2 long", key)


def murmur64_of(key: Column, seed: int = 0) -> Column:
    def kernel(keys: pd.Series) -> pd.Series:
        return pd.Series(signed(murmur64(as_bytes(keys), seed)))

    return _udf(kernel, "long", key)


def murmur128_swapped_of(key: Column, seed: int = 0) -> Column:
    """murmur128_of() with its halves in the other order."""
    h = murmur128_of(key, seed)
    return F.struct(h["h2"].alias("h1"), h["h1"].alias("h2"))


def murmur32_family(key: Column, base: int, n: int) -> Column:
    """Array of n hashes, with seeds from base on."""
    return F.array(*(murmur32_of(key, base + i) for i in range(n)))


def native64_of(key: Column, seed: int = 0) -> Column:
    """A seeded 64-bit family without leaving the JVM."""
    return F.xxhash64(F.lit(seed), key)


def hex64(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def fast_range64(h: Column, n) -> Column:
    """(h * n) >> 64 of an unsigned 64-bit hash in a long, exact for n below 2^31."""
    n = n if isinstance(n, Column) else F.lit(n).cast("long")
    high, low = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftrightunsigned(high * n + F.shiftrightunsigned(low * n, 32), 32)


def fast_range16(h: Column, n) -> Column:
    """((h >> 16) * n) >> 16 of a 32-bit hash; reaches at most 65,536 values."""
    return F.shiftrightunsigned(F.shiftrightunsigned(h, 16) * n, 16)


def mod_range(h: Column, n) -> Column:
    """An unsigned 64-bit hash in a long, modulo n (below 2^31)."""
    high, low = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.pmod(F.pmod(F.pmod(high, n) * (F.lit(1 << 32) % n), n) + F.pmod(low, n), n)


def mod_range128(h1: Column, h2: Column, n) -> Column:
    """The 128-bit hash with h2 as its upper half, modulo n (below 2^31)."""
    wrap = F.pmod((F.lit(1 << 32) % n) * (F.lit(1 << 32) % n), n)
    return F.pmod(mod_range(h2, n) * wrap + mod_range(h1, n), n)
