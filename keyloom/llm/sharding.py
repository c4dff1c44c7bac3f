"""Contiguous shards of near-equal bytes, from global prefix sums over per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, prefix, range_bounds, stage

ROWS_PER_BUCKET = 20_000


def assign_shards(docs: DataFrame, shards: int = 16, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Put documents into `shards` contiguous doc_id ranges whose byte sizes are near equal (law "bytes").

    Only doc_id and text are read. A document's size is the UTF-8 bytes of its text (null: none) plus 1. Documents are
    laid end to end in ascending doc_id (null first; ties by size, then checksum; identical rows are interchangeable),
    and a document belongs to the shard in which the byte before it lies, so a shard is off its equal target by less
    than one document on either side. A document larger than a target leaves the shards that it spans empty.

    The order is cut into range buckets, each summed on its own; a table of bucket totals (bounded by
    common.MAX_BUCKETS) gives every bucket its starting byte, so no window spans more than one bucket.
    Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 in its shard), grown_shard (null under this
    law). An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bounds = range_bounds(docs, "doc_id", rows_per_bucket)
    flat = stage(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            bucket_of(F.col("doc_id"), bounds).alias("bucket"),
        ),
        "shard-sizes",
    )
    totals = flat.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    total = flat.agg(F.sum("size")).first()[0] or 1
    w = Window.partitionBy("bucket").orderBy("doc_id", "size", "text_crc32")
    start = F.col("bytes_before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = stage(
        flat.join(F.broadcast(prefix(totals, "bucket", ["bytes", "rows"])), "bucket").select(
            "doc_id",
            "size",
            "text_crc32",
            F.floor(start * shards / F.lit(total)).cast("int").alias("shard"),
            (F.col("rows_before") + F.row_number().over(w)).alias("at"),
        ),
        "shard-places",
    )
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
