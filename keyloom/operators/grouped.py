"""Kernels over groups: one shuffle, then a stream of sorted groups through each Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship


def _stream(batches: Iterator[pa.RecordBatch], key: str, kernel: Callable, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    def run(table: pa.Table) -> pa.RecordBatch:
        keys = table.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        rows: dict[str, list] = {n: [] for n in out.names}
        for lo, hi in zip(cuts, cuts[1:]):
            for n, v in kernel(table.slice(lo, hi - lo)).items():
                rows[n].extend(v)
        return pa.RecordBatch.from_pydict(rows, schema=out)

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not len(table):
            continue
        keys = table.column(key).to_numpy()
        last = int(np.flatnonzero(keys != keys[-1]).max(initial=-1)) + 1
        if last:
            yield run(table.slice(0, last))
        held = table.slice(last)
    if held is not None and len(held):
        yield run(held)


def by_group(df: DataFrame, key: str, order: list[str], kernel: Callable[[pa.Table], dict[str, list]], schema: str) -> DataFrame:
    """kernel(rows of one value of an integer column, sorted by order) for every value; it returns columns of rows.

    Groups stream one after the other, so a worker holds one group and one batch, without a call into Python for each
    group. Groups must be small by construction (buckets, shards).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))
    # A number of partitions of its own, so that few bytes, whose kernels may take long, are not put into one task.
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    sorted_groups = df.repartition(tasks, key).sortWithinPartitions(key, *order)
    return sorted_groups.mapInArrow(lambda batches: _stream(batches, key, kernel, out), schema)


def by_group_with(rows: DataFrame, side: DataFrame, key: str, kernel: Callable[[pa.Table, list[dict]], dict[str, list]], schema: str) -> DataFrame:
    """kernel(rows of a key's value, that value's rows of side) for every value that both have.

    Instead of a join, which would repeat a side's large values in every row and be shuffled again, both are dealt by
    the key in one shuffle, and a group starts with its rows of side (a few by construction: an artifact's parts).
    """
    names = [c for c in side.columns if c != key]
    marked = side.select(key, F.lit(True).alias("_side"), *(F.col(c).alias(f"_side_{c}") for c in names))
    both = rows.withColumn("_side", F.lit(False)).unionByName(marked, allowMissingColumns=True).withColumn("_order", ~F.col("_side"))

    def run(group: pa.Table) -> dict[str, list]:
        n = group.column("_side").to_pylist().count(True) if group.column("_side")[0].as_py() else 0
        if n in (0, len(group)):
            return {}
        return kernel(group.slice(n), [{c: r[f"_side_{c}"] for c in names} for r in group.slice(0, n).select([f"_side_{c}" for c in names]).to_pylist()])

    return by_group(both, key, ["_order"], run, schema)
