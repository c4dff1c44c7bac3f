"""Intermediate tables that several parts of a plan read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder in spark.checkpoint.dir (a temporary one only where that is unset and the session
    is local), deleted when the driver's JVM ends."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.applicationId not in _fallback:
            _fallback[sc.applicationId] = tempfile.mkdtemp(prefix="keyloom-")
        folder = _fallback[sc.applicationId]
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def persist(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that its lineage ends and lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
