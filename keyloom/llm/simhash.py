"""SimHash near-duplicates through deletion-variant signatures."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import stage
from .components import connected_components

BITS = 64
SHINGLE = 4
MAX_DISTANCE = 4
SEED = 42
#: Fingerprints up to which the index has few, short segments.
FEW = 1 << 22
#: Tables of at most this many rows (16 bytes each) are broadcast.
BROADCAST_ROWS = 200_000
#: Shingles whose bits are counted at a time: bounds the memory that a very long text takes.
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a whole text's word shingles, repeats included; 0 if it has no word."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, digest = max(1, len(words) - width + 1), xxhash.xxh64_intdigest
    spans = list(zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()))
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, n, BLOCK):
        hashes = np.array([digest(joined[s:e], seed) for s, e in spans[lo : lo + BLOCK]], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints, pa.int64())], names=["doc_id", "text_hash", "fingerprint"])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text) and fingerprint (as a signed long) of every document."""
    ship(docs.sparkSession)
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return own.mapInArrow(lambda batches: _fingerprints(batches, width), "doc_id long, text_hash long, fingerprint long")


def segments(max_distance: int, n: int = 0) -> list[int]:
    """Masks of bits, of which one holds one bit at most of any max_distance differing ones, for n fingerprints.

    Few fingerprints: max_distance / 2 + 1 segments, so few that one has at most one of the bits. More than FEW: every
    two of max_distance + 1 segments together, as the two that differ least have less than two of the bits; these are
    longer, so less chance meets in a key, and there are more of them.
    """
    parts = max_distance // 2 + 1 if n <= FEW else max_distance + 1
    cuts = [BITS * i // parts for i in range(parts + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]
    return masks if n <= FEW or parts < 2 else [a | b for a, b in itertools.combinations(masks, 2)]


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x)


def _bits(mask: int) -> list[int]:
    return [i for i in range(BITS) if mask >> i & 1]


def _bit(x: Column) -> Column:
    """Position of the only set bit of x."""
    return F.when(x < 0, F.lit(63)).otherwise(F.bit_count(x - 1))


def _variants(x: Column, masks: list[int]) -> Column:
    """Signatures of every part with one bit deleted: (number of the part and position of the bit, the part without it)."""
    made = [F.struct(F.lit(p * BITS + i).alias("wild"), x.bitwiseAND(_long(mask & ~(1 << i))).alias("rest")) for p, mask in enumerate(masks) for i in _bits(mask)]
    return F.array(*made)


def _only_signature(x: Column, masks: list[int]) -> Column:
    """Of the signatures that two fingerprints with difference x share, the one that reports them: of the first part
    with a difference of one bit at most, the one without that bit, or without the part's first if there is none."""
    out = None
    for p, mask in enumerate(masks):
        part = x.bitwiseAND(_long(mask))
        for n, wild in ((0, F.lit(p * BITS + _bits(mask)[0])), (1, _bit(part) + p * BITS)):
            holds = F.bit_count(part) == n
            out = F.when(holds, wild) if out is None else out.when(holds, wild)
    return out


def link_fingerprints(prints: DataFrame, max_distance: int = MAX_DISTANCE, n: int = 0) -> DataFrame:
    """All pairs a < b of distinct fingerprints that differ in at most max_distance bits, each once; n is about how many
    there are, which changes the index alone.

    Every fingerprint is indexed under its one-wildcard signatures, one a bit of each of segments(), and signatures are
    joined by equality. The join's own condition verifies the distance and lets one shared signature report a pair, so
    the join emits links only. It is always a merge join: Spark takes an exploded row for as large as what it came from,
    so it would broadcast the 64 rows or more of each print, through the driver, where the prints alone look small.
    """
    parts = segments(max_distance, n)
    index = prints.select("fingerprint", F.explode(_variants(F.col("fingerprint"), parts)).alias("s")).select("fingerprint", "s.wild", "s.rest")
    a, b = index.alias("a"), index.alias("b")
    x = F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint"))
    near = (F.col("a.fingerprint") < F.col("b.fingerprint")) & (F.bit_count(x) <= max_distance) & (F.col("a.wild") == _only_signature(x, parts))
    return a.hint("merge").join(b.hint("merge"), (F.col("a.wild") == F.col("b.wild")) & (F.col("a.rest") == F.col("b.rest")) & near).select(F.col("a.fingerprint").alias("a"), F.col("b.fingerprint").alias("b"))


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE, width: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fingerprint (16 hex digits) and component_id of every document.

    Reads doc_id and text; a text without a word (null, empty) has fingerprint zero and links like any other. Copies
    share a fingerprint and are one node of the graph; nodes are linked by link_fingerprints(). component_id is the
    smallest doc_id in the connected component (null only if all its doc_ids are null). Repeated rows come back as
    often as they stand in docs.
    """
    own = stage(fingerprints(docs, width), "fingerprints")
    nodes = stage(own.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    parts = connected_components(link_fingerprints(nodes.select("fingerprint"), max_distance, nodes.count()))
    # Only linked nodes are joined by component, so a large one's rows are few beside all.
    linked = stage(nodes.join(parts.withColumnRenamed("node", "fingerprint"), "fingerprint"), "fingerprint-linked")
    least = stage(linked.groupBy("component").agg(F.min("least").alias("component_id")), "fingerprint-roots")
    moved = linked.join(F.broadcast(least) if least.count() <= BROADCAST_ROWS else least, "component").select("fingerprint", "component_id")
    of_node = stage(nodes.join(moved, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "least").alias("component_id")), "fingerprint-components")
    return own.join(of_node, "fingerprint").select("doc_id", "text_hash", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, found: DataFrame, group: Column) -> DataFrame:
    """The rows of docs that come first in their group of found (doc_id, text_hash): by doc_id (none comes last), then
    by text_hash, once."""
    rank = lambda d, h: F.struct(d.isNull().alias("n"), d.alias("d"), h.alias("h"))
    keep = found.groupBy(group).agg(F.min(rank(F.col("doc_id"), F.col("text_hash"))).alias("k")).select("k.d", "k.h", "k.n")
    own = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("doc_id", F.lit(0)).alias("d0"), F.col("doc_id").isNull().alias("n0"), F.xxhash64("text").alias("h0"))
    kept = keep.select(F.coalesce("d", F.lit(0)).alias("d0"), F.col("n").alias("n0"), F.col("h").alias("h0")).distinct()
    return own.join(kept, ["d0", "n0", "h0"], "left_semi").dropDuplicates(["d0", "n0", "h0"]).select("row.*")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs (doc_id, text and others) without near-duplicates: of each component the document with the
    smallest doc_id stays (no doc_id comes last; then by a hash of the text), once."""
    return keep_first(docs, near_duplicates(docs, **options), F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint")))
