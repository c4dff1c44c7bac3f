"""Looking up keys that arrive in a stream, against an artifact that is already built."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def lookup_stream(keys: DataFrame, look_up: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A stream writer that hashes each micro-batch of keys and hands it, with its batch number, to the sink.

    The artifact is static, so batches don't depend on each other; a sink that overwrites by batch number makes
    repeated batches harmless."""
    return keys.writeStream.foreachBatch(lambda batch, number: sink(look_up(batch), number))
