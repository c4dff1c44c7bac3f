"""Token ids as length-delimited binary records with masked checksums, and a separate offset index.

A file holds records one after the other, each framed as

    length of the payload, unsigned 64-bit | masked CRC-32 of those 8 bytes | payload | masked CRC-32 of the payload

all little-endian. A payload is a byte that tells whether there is a doc_id, the doc_id (signed 64-bit), a byte with
the width of an id in bytes (2 or 4), then the ids. A checksum is masked by rotating it right by 15 bits and adding
0xA282EAD8, so that a checksum over bytes that hold checksums stays sound. The index (same name, .idx) has 16 bytes a
record: its offset (unsigned 64-bit) and number of ids (unsigned 64-bit), so a reader can shuffle and seek.
"""

from __future__ import annotations

import contextlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..plans.persist import shared_path
from .common import bucket_of, prefix, range_bounds, stage
from .tokens import blocks, encoder

MASK = 0xA282EAD8
#: Bytes of text in a file, up to one cell more, and rows in a cell.
BYTES_PER_FILE, ROWS_PER_CELL = 1 << 24, 250
HEAD = struct.Struct("<QI")
WHO = struct.Struct("<BqB")
ENTRY = struct.Struct("<QQ")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return WHO.pack(doc_id is not None, doc_id or 0, width) + ids


def read_record(data: bytes, at: int) -> tuple[int | None, np.ndarray, int]:
    """doc_id, ids and the offset after the record at an offset; ValueError if a checksum is wrong."""
    length, check = HEAD.unpack_from(data, at)
    body = at + HEAD.size
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"the length at {at} is damaged")
    got = data[body : body + length]
    if len(got) != length or masked(got) != struct.unpack_from("<I", data, body + length)[0]:
        raise ValueError(f"the record at {at} is damaged")
    known, doc_id, width = WHO.unpack_from(got)
    return (doc_id if known else None), np.frombuffer(got, f"<u{width}", offset=WHO.size), body + length + 4


def _files(path: str):
    """A file system and the path in it: plain files for file:, else what pyarrow finds for the scheme."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if rest and scheme != "file":
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(rest.replace("///", "/", 1) if rest else path)


class _Writer:
    """One record file and its index, under names of their own until they are whole."""

    def __init__(self, folder: str, bucket: int):
        self.bucket, self.uri = bucket, f"{folder}/part-{bucket:05d}"
        self.fs, self.path = _files(self.uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.draft = f"{os.path.dirname(self.path)}/.{uuid.uuid4().hex}"
        self.out, self.index = self.fs.open_output_stream(f"{self.draft}.rec"), self.fs.open_output_stream(f"{self.draft}.idx")
        self.at = self.docs = self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes, width: int) -> None:
        record = frame(payload(doc_id, ids, width))
        self.index.write(ENTRY.pack(self.at, len(ids) // width))
        self.out.write(record)
        self.at += len(record)
        self.docs += 1
        self.tokens += len(ids) // width

    def discard(self) -> None:
        """Remove what a task that failed has written."""
        for stream, end in ((self.out, "rec"), (self.index, "idx")):
            with contextlib.suppress(OSError):
                stream.close()
                self.fs.delete_file(f"{self.draft}.{end}")

    def close(self) -> dict:
        self.out.close()
        self.index.close()
        for end in ("rec", "idx"):
            self.fs.move(f"{self.draft}.{end}", f"{self.path}.{end}")
        return {"bucket": [self.bucket], "file": [self.uri], "docs": [self.docs], "tokens": [self.tokens], "bytes": [self.at]}


MANIFEST = "bucket int, file string, docs long, tokens long, bytes long"
MANIFEST_KINDS = {"bucket": pa.int32(), "file": pa.string(), "docs": pa.int64(), "tokens": pa.int64(), "bytes": pa.int64()}


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    coder = encoder(tokenizer)
    for batch in batches:
        for part in blocks(batch):
            ids, bounds = coder.closed(part.column("text"), end_id)
            data = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(bounds * coder.dtype.itemsize), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([part.column("bucket"), part.column("doc_id"), part.column("text_hash"), data.cast(pa.binary())], names=["bucket", "doc_id", "text_hash", "ids"])


def _write(batches: Iterator[pa.RecordBatch], width: int, folder: str) -> Iterator[pa.RecordBatch]:
    out, kinds = None, pa.schema(MANIFEST_KINDS)
    try:
        for batch in batches:
            for bucket, doc_id, ids in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                if out is None or out.bucket != bucket:
                    if out:
                        yield pa.RecordBatch.from_pydict(out.close(), schema=kinds)
                    out = _Writer(folder, bucket)
                out.add(doc_id, ids.as_py(), width)
        if out:
            yield pa.RecordBatch.from_pydict(out.close(), schema=kinds)
    except BaseException:
        if out:
            out.discard()
        raise


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, start in zip(batch.column("file").to_pylist(), batch.column("tokens_before").to_pylist()):
            where, path = _files(file)
            with where.open_input_file(f"{path}.idx") as f:
                index = f.read()
            rows = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
            with where.open_input_file(f"{path}.rec") as f:
                size, offsets = f.size(), [ENTRY.unpack_from(index, i) for i in range(0, len(index), ENTRY.size)]
                for (at, n), (until, _) in zip(offsets, [*offsets[1:], (size, 0)]):
                    f.seek(at)
                    doc_id, ids, _ = read_record(f.read(until - at), 0)
                    if len(ids) != n:
                        raise ValueError(f"{file}: the index gives {n} ids at {at}, the record has {len(ids)}")
                    for k, v in zip(rows, (doc_id, start, n, zlib.crc32(ids.astype("<u4").tobytes()))):
                        rows[k].append(v)
                    start += n
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(k, pa.int64()) for k in rows]))


def file_bounds(docs: DataFrame, bytes_per_file: int, rows_per_cell: int) -> list:
    """Smallest doc_id of each file, ascending: range cells of about rows_per_cell rows, put together up to
    bytes_per_file bytes of text. The driver holds one total a cell, at most MAX_BUCKETS."""
    cells = range_bounds(docs, "doc_id", rows_per_cell)
    sizes = docs.select(bucket_of(F.col("doc_id"), cells).alias("cell"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"))
    totals = dict(sizes.groupBy("cell").agg(F.sum("size")).collect())
    out, held = [], 0
    for i, first in enumerate(cells):
        if not out or held + totals.get(i, 0) > bytes_per_file:
            out.append(first)
            held = 0
        held += totals.get(i, 0)
    return out


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 0, bytes_per_file: int = BYTES_PER_FILE, rows_per_cell: int = ROWS_PER_CELL, folder: str | None = None) -> DataFrame:
    """Encode every whole text (null: empty), append end_id, and write records in ascending doc_id (null first; ties
    by a hash of the text) to files that are themselves in that order. Returns the manifest, one row a file.

    Texts are encoded where they are read, and one shuffle brings ids to their files, one task a file; a task streams
    its sorted rows, so it holds one batch of ids. A repeated task writes the same bytes under a name of its own and
    moves them into place; one that fails removes what it has written.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or shared_path(spark, "records")
    bounds, width = file_bounds(docs, bytes_per_file, rows_per_cell), encoder(tokenizer).dtype.itemsize
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"), bucket_of(F.col("doc_id"), bounds).cast("int").alias("bucket"))
    coded = own.mapInArrow(lambda batches: _encode(batches, tokenizer, end_id), "bucket int, doc_id long, text_hash long, ids binary")
    placed = coded.repartitionById(max(1, len(bounds)), "bucket").sortWithinPartitions("bucket", "doc_id", "text_hash")
    return stage(placed.drop("text_hash").mapInArrow(lambda batches: _write(batches, width, folder), MANIFEST), "records-manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """Every document of a manifest's files, read back through the offset index and checked: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    ship(manifest.sparkSession)
    files = manifest.join(F.broadcast(prefix(manifest.select("bucket", "tokens"), "bucket", ["tokens"])), "bucket")
    tasks = max(1, min(4096, manifest.count()))
    dealt = files.select("file", "tokens_before", F.pmod("bucket", F.lit(tasks)).alias("task")).repartitionById(tasks, "task").drop("task")
    return dealt.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
