"""SimHash near-duplicates at a similarity: wide fingerprints in one-wildcard segments propose, whole sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import stage
from .components import connected_components
from .simhash import keep_first
from .tokens import blocks
from .words import grams, mixed, word_hashes

WIDTH = 5
SIMILARITY = 0.8
#: Probability that two sets at the similarity share a signature, and that their checks differ as little as is let.
RECALL, CHECK_RECALL = 0.994, 0.9995
#: 64-bit words of a fingerprint that make its check.
CHECK = 4
#: Least bits of a segment; it has so many that few of n fingerprints at random share one with a bit deleted.
SEGMENT = 16
#: Candidates of a node that are compared first; all others are if that doesn't put both in one component.
NEAREST = 3
#: Rounds in which the nearest candidates in other components are compared before all of them are.
ROUNDS = 2
#: Rows of a bucket that are compared pair by pair at once.
SMALL = 64
#: 64-bit words of a set's parities.
PARITY = 4
#: Tables of at most this many rows (56 bytes each at most) are broadcast.
BROADCAST_ROWS = 200_000
TIMES = np.random.default_rng(42).integers(0, 1 << 64, 4096, np.uint64) | np.uint64(1)


CHECKS = [f"check{i}" for i in range(CHECK)]
PARITIES = [f"parity{i}" for i in range(PARITY)]


class Shape(NamedTuple):
    """Bits of a segment, segments, segments in a 64-bit word, and bits in which two checks may differ."""

    bits: int
    segments: int
    in_word: int
    most: int

    @property
    def words(self) -> int:
        return max(CHECK, math.ceil(self.segments / self.in_word))


def shape(n: int, least: float = SIMILARITY) -> Shape:
    """What n fingerprints need. Two sets of Jaccard similarity s have the cosine 2s / (1 + s), so a bit of their
    SimHashes differs with probability p = arccos(2s / (1 + s)) / pi, and a segment of b bits in one bit at most with
    (1 - p)^b + b p (1 - p)^(b - 1). Segments are as many as RECALL takes."""
    p = math.acos(2 * least / (1 + least)) / math.pi
    bits = min(32, max(SEGMENT, math.ceil(math.log2(n + 1)) - 2))
    one = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    most, told = -1, 0.0
    while told < CHECK_RECALL:
        most += 1
        told += math.comb(64 * CHECK, most) * p**most * (1 - p) ** (64 * CHECK - most)
    return Shape(bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - one))) if one < 1 else 1, 64 // bits, most)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): text i has the distinct word shingles hashes[bounds[i] : bounds[i + 1]], ascending, by 48 bits
    each; one of all its words if they are fewer than width; none if it has no word. At most 65,536 texts."""
    hashes, words = word_hashes(texts)
    n = np.diff(words)
    owner = np.repeat(np.arange(len(n)), n)
    found = np.concatenate([grams(hashes, width), np.zeros(min(width - 1, len(hashes)), np.uint64)])
    inside = np.arange(len(hashes)) + width <= words[1:][owner]
    for i in np.flatnonzero((n > 0) & (n < width)):
        found[words[i]], inside[words[i]] = grams(hashes[words[i] : words[i + 1]], int(n[i]))[0] + np.uint64(n[i]), True
    # Texts by their number and 48 bits of a hash sort as one number.
    keys = np.sort((owner[inside].astype(np.uint64) << np.uint64(48)) | (found[inside] >> np.uint64(16)))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    bounds = np.searchsorted(keys >> np.uint64(48), np.arange(len(n) + 1, dtype=np.uint64))
    return keys & np.uint64((1 << 48) - 1), bounds


def simhashes(hashes: np.ndarray, bounds: np.ndarray, words: int) -> np.ndarray:
    """SimHashes of sets, as rows of 64-bit words; zero for an empty set.

    Every eighth bit of a hash is spread over the bytes of a number, and up to 255 such numbers are added without carry.
    """
    n = np.diff(bounds)
    out = np.zeros((len(n), words), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    parts = -(-n[full] // 255)
    first = np.cumsum(parts) - parts
    starts = np.repeat(bounds[:-1][full], parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    lanes = np.uint64(0x0101010101010101)
    for w in range(words):
        mine = mixed(hashes * TIMES[w])
        counts = np.empty((len(full), 8, 8), np.int64)
        for bit in range(8):
            sums = np.add.reduceat((mine >> np.uint64(bit)) & lanes, starts)
            counts[:, :, bit] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        out[full, w] = np.packbits(2 * counts.reshape(-1, 64) > n[full][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _prints(batches: Iterator[pa.RecordBatch], width: int, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch):
            hashes, bounds = shingle_sets(part.column("text"), width)
            same = np.array([xxhash.xxh64_intdigest(hashes[lo:hi].tobytes()) for lo, hi in zip(bounds, bounds[1:])], np.uint64).view(np.int64)
            made = simhashes(hashes, bounds, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(same), pa.array(np.diff(bounds)), pa.array(list(made), pa.list_(pa.int64()))], names=["doc_id", "text_hash", "same", "n", "print"])


def _signatures(batches: Iterator[pa.RecordBatch], made: Shape) -> Iterator[pa.RecordBatch]:
    """(key, node, check) for every segment of a fingerprint and every bit of it, which the key leaves out; the check is
    the fingerprint's first words."""
    bits, mask = np.uint64(made.bits), np.uint64((1 << made.bits) - 1)
    wild = np.arange(made.bits, dtype=np.uint64)
    for batch in batches:
        for lo in range(0, len(batch), 512):
            part = batch.slice(lo, 512)
            node = part.column("node").to_numpy()
            if not len(node):
                continue
            prints = np.array(part.column("print").to_pylist(), np.int64).view(np.uint64)
            for s in range(made.segments):
                segment = prints[:, s // made.in_word] >> np.uint64(s % made.in_word) * bits & mask
                rest = segment[:, None] & ~(np.uint64(1) << wild)
                key = ((np.uint64(s) << np.uint64(5) | wild)[None, :] << np.uint64(32)) | rest
                yield pa.RecordBatch.from_pydict({"key": key.reshape(-1).view(np.int64), "node": np.repeat(node, made.bits), **{f"check{i}": np.repeat(prints[:, i], made.bits).view(np.int64) for i in range(CHECK)}})


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(0, dtype=np.int64)


def _can_be_alike(n, m, x, y, apart, least: float):
    """Whether sets of n and m elements, of which x and y are in another set and whose parities differ in `apart` bits,
    could be as alike as `least`; for columns as for arrays.

    An element that is in one of both sets alone turns one parity, so of the x and y elements at least `apart` are in one
    of both alone, as all others of the n and m are. Such elements are at most (1 - least) / (1 + least) times n + m, and
    each set has least / (1 + least) times n + m in common with the other.
    """
    common = (least / (1 + least) - 1e-12) * (n + m)
    return (x >= common) & (y >= common) & (apart + (n - x) + (m - y) <= ((1 - least) / (1 + least) + 1e-12) * (n + m))


def _buckets(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of each bucket (rows with one key, which come together): its rows whose checks differ from another's in at most
    `most` bits; and candidates, as rows with key -1, node, other and check0 (the distance). Each row has one candidate
    at most: the nearest of the SMALL rows before and after it, however large the bucket."""
    kinds = pa.schema([(n, pa.int64()) for n in ("key", "node", "other", *CHECKS)])

    def of(key: np.ndarray, node: np.ndarray, check: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([starts, [len(key)]]))
        after = np.repeat(starts + size, size) - np.arange(len(key)) - 1
        # The distance to the nearest so far, and which row it is.
        best = np.full(len(key), np.iinfo(np.int64).max)
        own = np.flatnonzero(after)
        for step in range(1, min(SMALL, int(size.max())) + 1):
            own = own[after[own] >= step]
            other = own + step
            apart = _apart(check[:, own], check[:, other]) << 40
            best[own] = np.minimum(best[own], apart | other)
            best[other] = np.minimum(best[other], apart | own)
        near = best >> 40 <= most
        pairs = np.flatnonzero(near)
        nearest = best[pairs] & ((1 << 40) - 1)
        # Of a bucket that is larger than what rows were compared with, the others may be near rows further on.
        for i in np.flatnonzero(~near & np.repeat(size > SMALL + 1, size)):
            lo = i + after[i] + 1 - size[np.searchsorted(starts, i, "right") - 1]
            near[i] = (_apart(check[:, lo : i + after[i] + 1], check[:, i, None]) <= most).sum() > 1
        rows = np.flatnonzero(near)
        out = [[np.full(len(pairs), -1), node[pairs], node[nearest], best[pairs] >> 40, *[np.zeros(len(pairs), np.int64)] * (CHECK - 1)], [key[rows], node[rows], np.full(len(rows), -1), *check[:, rows].view(np.int64)]]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=kinds)

    held = np.empty((2 + CHECK, 0), np.int64)
    for batch in batches:
        rows = np.concatenate([held, np.array([batch.column(n).to_numpy() for n in ("key", "node", *CHECKS)], np.int64)], axis=1)
        if rows.shape[1]:
            last = int(np.flatnonzero(rows[0] != rows[0][-1]).max(initial=-1)) + 1
            held = rows[:, last:]
            if last:
                yield of(rows[0, :last], rows[1, :last], rows[2:, :last].view(np.uint64))
    if held.shape[1]:
        yield of(held[0], held[1], held[2:].view(np.uint64))


def _across(batches: Iterator[pa.RecordBatch], most: int, least: float) -> Iterator[pa.RecordBatch]:
    """Of each row of a bucket the nearest of the SMALL rows before and after it that is in another component and could
    be alike: a, b (ascending) and d, the distance of their checks."""

    def of(rows: np.ndarray) -> pa.RecordBatch:
        (key, node, root, n, shared), check, parity = rows[:5], rows[5 : 5 + CHECK].view(np.uint64), rows[5 + CHECK :].view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([starts, [len(key)]]))
        after = np.repeat(starts + size, size) - np.arange(len(key)) - 1
        none = np.iinfo(np.int64).max
        best, own = np.full(len(key), none), np.flatnonzero(after)
        for step in range(1, min(SMALL, int(size.max())) + 1):
            own = own[after[own] >= step]
            x = own[root[own] != root[own + step]]
            d = _apart(check[:, x], check[:, x + step])
            x, d = x[d <= most], d[d <= most]
            y = x + step
            ok = _can_be_alike(n[x], n[y], shared[x], shared[y], _apart(parity[:, x], parity[:, y]), least)
            x, y, d = x[ok], y[ok], d[ok] << 40
            best[x] = np.minimum(best[x], d | y)
            best[y] = np.minimum(best[y], d | x)
        pairs = np.flatnonzero(best < none)
        nearest = best[pairs] & ((1 << 40) - 1)
        return pa.RecordBatch.from_pydict({"a": np.minimum(node[pairs], node[nearest]), "b": np.maximum(node[pairs], node[nearest]), "d": best[pairs] >> 40})

    names = ("key", "node", "root", "node_n", "node_shared", *CHECKS, *(f"node_{c}" for c in PARITIES))
    held = np.empty((len(names), 0), np.int64)
    for batch in batches:
        rows = np.concatenate([held, np.array([batch.column(n).to_numpy() for n in names], np.int64)], axis=1)
        if rows.shape[1]:
            last = int(np.flatnonzero(rows[0] != rows[0][-1]).max(initial=-1)) + 1
            held = rows[:, last:]
            if last:
                yield of(rows[:, :last])
    if held.shape[1]:
        yield of(held)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch):
            hashes, bounds = shingle_sets(part.column("text"), width)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))], names=["node", "words"])


def _first_signature(x: list[Column], made: Shape) -> Column:
    """Of the signatures that two fingerprints share, whose checks differ by the words x, the head of the first key: of
    the first segment in the check that differs in one bit at most, the one without that bit, or without the segment's
    lowest if there is none; null if the check has no such segment."""
    out = None
    for s in range(min(made.segments, CHECK * made.in_word)):
        part = F.shiftrightunsigned(x[s // made.in_word], s % made.in_word * made.bits).bitwiseAND(F.lit((1 << made.bits) - 1))
        for n, wild in ((0, F.lit(0)), (1, F.bit_count(part - 1))):
            head = (F.lit(s << 5) + wild).cast("long")
            out = F.when(F.bit_count(part) == n, head) if out is None else out.when(F.bit_count(part) == n, head)
    return out


def _parities() -> list[Column]:
    """Of a group's elements w, whether those of each of 64 * PARITY classes are odd in number."""
    return [F.expr(f"bit_xor(IF((w >> 6 & {PARITY - 1}) = {i}, shiftleft(1L, CAST(w & 63 AS INT)), 0L))").alias(c) for i, c in enumerate(PARITIES)]


def linkable(sets: DataFrame, least: float = SIMILARITY, rounds: int = 3) -> DataFrame:
    """node, n, shared and PARITIES of the sets (node, words) that another could be as alike as `least`: n elements, of
    which `shared` are in another of these sets, and the parities of these.

    Two sets of n and m elements with o in common have the Jaccard similarity o / (n + m - o), which is `least` or more
    only if o is least / (1 + least) times n + m, and least times n. An element that no other set has is in no common
    part. So a copy with many words of its own goes without a comparison, and what is in sets that went counts no more
    in the next round. No set goes that has a partner.
    """
    left = sets
    for _ in range(rounds):
        words = left.select("node", F.explode("words").alias("w"))
        alone = words.groupBy("w").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1").groupBy("node").agg(F.count("*").alias("alone"), *_parities())
        zero = F.lit(0).cast("long")
        own = left.select("node", F.size("words").alias("n")).join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", zero)).alias("shared"), *(F.coalesce(c, zero).alias(c) for c in PARITIES))
        own = stage(own.filter(F.col("shared") >= F.col("n") * (least - 1e-12)), "alike-linkable")
        left = sets.join(F.broadcast(own.select("node")) if own.count() <= BROADCAST_ROWS else own.select("node"), "node", "left_semi")
    # Parities of all elements and of those that no other set has give those of the rest.
    every = left.select("node", F.explode("words").alias("w")).groupBy("node").agg(*_parities()).select("node", *(F.col(c).alias(f"all_{c}") for c in PARITIES))
    rest = (F.col(c).bitwiseXOR(F.coalesce(f"all_{c}", zero)).alias(c) for c in PARITIES)
    return stage(own.join(every, "node", "left").select("node", "n", "shared", *rest), "alike-linkable")


def near_duplicates(docs: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash and root of every document: documents with one root are near-duplicates, linked by pairs
    whose sets of word shingles have a Jaccard similarity of `least` or more.

    Reads doc_id and text (null: empty). Texts with equal sets are one node (those without a word, too, which are like
    nothing else). A node's SimHash has as many bits as shape() says; every segment is indexed with each of its bits
    deleted, and signatures are joined by equality; rows of a bucket whose checks are near are candidates. Those whose
    sets no other could be like enough, by linkable(), go, and pairs that _can_be_alike() excludes, which are never alike.
    The NEAREST nearest candidates of each node are compared by their whole sets, which joins large groups in steps linear
    in their size; then all candidates that are still in different components are, so none is left out. What can be missed
    is a pair that shares no signature: at `least`, 1 - RECALL.
    """
    ship(docs.sparkSession)
    made, checks = shape(docs.count(), least), ", ".join(f"{c} long" for c in CHECKS)
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text.alias("text"))
    own = stage(texts.mapInArrow(lambda batches: _prints(batches, width, made.words), "doc_id long, text_hash long, same long, n long, print array<long>"), "alike-prints")
    nodes = own.groupBy("same").agg(F.min("n").alias("n"), F.min("text_hash").alias("text_hash"), F.any_value("print").alias("print"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "alike-nodes")
    index = nodes.filter("n > 0").select("node", "print").mapInArrow(lambda batches: _signatures(batches, made), f"key long, node long, {checks}")
    # Shuffled rows come sorted by key, so a bucket's are together.
    index = index.repartition("key").sortWithinPartitions("key")
    found = stage(index.mapInArrow(lambda batches: _buckets(batches, made.most), f"key long, node long, other long, {checks}"), "alike-buckets")
    rows = found.filter("key >= 0").drop("other")
    named = rows.select("node").distinct()
    named = nodes.join(F.broadcast(named) if named.count() <= BROADCAST_ROWS else named, "node").select("node", "text_hash")
    few = named.count() <= BROADCAST_ROWS
    held = texts.select("text_hash", "text").join(F.broadcast(named) if few else named, "text_hash").select("node", "text")
    sets = stage(held.mapInArrow(lambda batches: _sets(batches, width), "node long, words array<long>").dropDuplicates(["node"]), "alike-sets")

    live = linkable(sets, least)
    few = live.count() <= BROADCAST_ROWS

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are as alike as asked for."""
        side = lambda c: sets.select(F.col("node").alias(c), F.col("words").alias(f"{c}_words"))
        both = F.size(F.array_intersect("a_words", "b_words"))
        alike = both >= F.lit(least) * (F.size("a_words") + F.size("b_words") - both)
        return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").filter(alike).select("a", "b")

    def could(pairs: DataFrame, *on: str) -> DataFrame:
        for c in on:
            own = live.select(F.col("node").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("n", "shared", *PARITIES)))
            pairs = pairs.join(F.broadcast(own) if few else own, c)
        return pairs

    def enough(a: str, b: str) -> Column:
        x, y = ([F.col(f"{side}_{c}") for c in ("n", "shared", *PARITIES)] for side in (a, b))
        apart = sum(F.bit_count(p.bitwiseXOR(q)) for p, q in zip(x[2:], y[2:]))
        return _can_be_alike(x[0], y[0], x[1], y[1], apart, least)

    pairs = found.filter("key < 0").groupBy(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).agg(F.min("check0").alias("d"))
    pairs = could(pairs, "a", "b").filter(enough("a", "b"))

    def closest(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, d) that are among the NEAREST nearest of a or of b."""
        nearest = Window.partitionBy("node").orderBy("d", "a", "b")
        ends = pairs.select("a", "b", "d", F.explode(F.array("a", "b")).alias("node")).withColumn("nth", F.row_number().over(nearest))
        return ends.filter(F.col("nth") <= NEAREST).select("a", "b").distinct()

    def rooted(of_node: DataFrame) -> DataFrame:
        return could(rows, "node").join(of_node, "node", "left").select("key", "node", "node_n", "node_shared", *CHECKS, *(f"node_{c}" for c in PARITIES), F.coalesce("component", "node").alias("root"))

    tried = stage(closest(pairs), "alike-pairs")
    links = stage(linked(tried), "alike-links")
    of_node = stage(connected_components(links), "alike-components")
    for _ in range(ROUNDS):
        dealt = rooted(of_node).repartition("key").sortWithinPartitions("key")
        pairs = dealt.mapInArrow(lambda batches: _across(batches, made.most, least), "a long, b long, d long").groupBy("a", "b").agg(F.min("d").alias("d"))
        fresh = stage(closest(pairs.join(tried, ["a", "b"], "left_anti")), "alike-pairs")
        more = stage(linked(fresh), "alike-links")
        tried = tried.unionByName(fresh)
        if not more.take(1):
            break
        links = links.unionByName(more)
        of_node = stage(connected_components(links), "alike-components")
    sizes = of_node.groupBy(F.col("component").alias("root")).agg(F.count("*").alias("size"))
    bucket = Window.partitionBy("key")
    most = F.max(F.struct(F.coalesce("size", F.lit(1)).alias("size"), "root")).over(bucket)
    split = rooted(of_node).join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, "root", "left").select("*", F.min("root").over(bucket).alias("lo"), F.max("root").over(bucket).alias("hi"), most["root"].alias("main"))
    open_ = stage(split.filter("lo < hi").select("key", "node", "node_n", "node_shared", *CHECKS, *(f"node_{c}" for c in PARITIES), "root", "main"), "alike-open")
    # Every such pair has a side that isn't in the bucket's largest component. One signature reports it, once.
    a, b = open_.filter("root <> main").alias("a"), open_.alias("b")
    apart = [F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")) for c in CHECKS]
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & ((F.col("b.root") == F.col("b.main")) | (F.col("a.node") < F.col("b.node")))
    near = near & (sum(map(F.bit_count, apart)) <= made.most) & enough("a.node", "b.node")
    head = F.shiftrightunsigned("a.key", 32)
    near = near & (F.coalesce(_first_signature(apart, made), head) == head)
    left = a.join(b, near).select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()
    more = stage(linked(left.join(tried, ["a", "b"], "left_anti")), "alike-links")
    if more.take(1):
        of_node = stage(connected_components(links.unionByName(more)), "alike-components")
    roots = nodes.select("same", "node").join(of_node, "node", "left").select("same", F.coalesce("component", "node").alias("root"))
    return own.join(roots, "same").select("doc_id", "text_hash", "root")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs (doc_id, text and others) without near-duplicates, by the same rule as simhash.keep_one()."""
    return keep_first(docs, near_duplicates(docs, **options), F.col("root"))
