"""Bounded-space online packing of token ids into windows."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import stage
from .tokens import blocks, encoder

WINDOW = 2048
OPEN = 64
#: Partitions whose leftovers are merged in one task: at most 16 x OPEN windows, 8 MB of ids.
MERGED = 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class BoundedPacker:
    """At most `opened` windows of `size` ids. add() puts an item into the window it fits best; if it fits none and
    all are open, the fullest is emitted to make room. Ties go to the window that was opened first."""

    def __init__(self, size: int = WINDOW, opened: int = OPEN):
        self.size, self.opened, self.count = size, opened, 0
        self.free: list[tuple[int, int]] = []  # (room, number) of open windows, ascending
        self.items: dict[int, list] = {}

    def add(self, length: int, item) -> list[list]:
        """The windows (lists of items) that this closes."""
        closed = []
        i = bisect.bisect_left(self.free, (length, -1))
        if i < len(self.free):
            room, k = self.free.pop(i)
        else:
            if len(self.free) >= self.opened:
                closed.append(self.items.pop(self.free.pop(0)[1]))
            room, k = self.size, self.count
            self.count += 1
            self.items[k] = []
        self.items[k].append(item)
        if room == length:
            closed.append(self.items.pop(k))
        else:
            bisect.insort(self.free, (room - length, k))
        return closed

    def rest(self) -> list[list]:
        return [self.items[k] for _, k in self.free]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, opened: int = OPEN, with_ids: bool = False) -> DataFrame:
    """Pack every whole text (null: empty), encoded and closed by end_id, into sequences of at most `window` ids.

    A document is cut into full windows, each a sequence of its own, and a rest, which is placed into the partition's
    open windows. A partition keeps `opened` of them, so its memory doesn't grow with its rows. Windows still open at
    its end are leftovers: those of MERGED partitions at a time are packed anew, largest rest first. A retried task
    makes the same windows, since a partition reads its rows in order.

    Returns a row per piece: doc_id, start (ids of its document before it), length, ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset (in its sequence, gapless from 0), and ids
    (an array) if with_ids. Every document has at least end_id, so an empty text has one piece.
    """
    ship(docs.sparkSession)
    schema = SCHEMA + ", last boolean, task int" + (", ids array<int>" if with_ids else "")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = pa.schema([(n, pa.bool_() if n == "last" else pa.int32() if n == "task" else pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n in names])

    def rows(windows: list[list], first: int, last: bool, task: int) -> pa.RecordBatch:
        out = {n: [] for n in names}
        for k, items in enumerate(windows):
            offset = 0
            for doc_id, start, crc, total, length, ids in items:
                for n, v in zip(names, (doc_id, start, length, crc, total, first + k, offset, last, task, ids)):
                    out[n].append(v)
                offset += length
        return pa.RecordBatch.from_pydict(out, schema=kinds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer, task = encoder(tokenizer), BoundedPacker(window, opened), TaskContext.get().partitionId()
        made = task << 36
        for batch in batches:
            for part in blocks(batch):
                coded, bounds = coder.closed(part.column("text"), end_id)
                coded, closed, bounds = coded.astype("<u4"), [], bounds.tolist()
                for doc_id, lo, hi in zip(part.column("doc_id").to_pylist(), bounds, bounds[1:]):
                    ids = coded[lo:hi]
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        item = (doc_id, start, zlib.crc32(piece.tobytes()), len(ids), len(piece), piece.astype(np.int32) if with_ids else None)
                        closed += [[item]] if len(piece) == window else packer.add(len(piece), item)
                yield rows(closed, made, False, task)
                made += len(closed)
        yield rows(packer.rest(), made, True, task)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "task", "sequence_id", "offset"], ascending=[False, True, True, True], ignore_index=True)
        base, free, at, made = (1 << 62) + (int(group["task"].iloc[0]) // MERGED << 36), [], [], 0
        for length in group["length"]:
            i = bisect.bisect_left(free, (length, -1))
            room, k = free.pop(i) if i < len(free) else (window, made)
            made += room == window
            at.append((k, window - room))
            bisect.insort(free, (room - length, k))
        group["sequence_id"], group["offset"] = [base + k for k, _ in at], [o for _, o in at]
        return group

    placed = stage(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(place, schema), "packed")
    out = [c for c in names if c not in ("last", "task")]
    left = placed.filter("last").groupBy((F.col("task") / MERGED).cast("int")).applyInPandas(merge, schema)
    return placed.filter(~F.col("last")).select(*out).unionByName(left.select(*out))
