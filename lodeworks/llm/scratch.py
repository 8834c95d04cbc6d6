"""Shared scratch space: written tables live where every executor sees them."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: dict[str, SparkSession] = {}  # tables that the driver's end removes


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where it is unset and the master is local (tests) a folder of our own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodeworks-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lodeworks-{name}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_clear)
    _left[path] = spark
    return path


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: computed once, survives lost executors.

    drop() removes the table when nothing needs it any more; what is left goes when the driver ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._lodeworks_path = path
    return made


def drop(*tables: DataFrame) -> None:
    """Removes tables that settled() wrote; what was made of them has to be written by then."""
    for table in tables:
        _remove(table._lodeworks_path)


def _remove(path: str) -> None:
    spark = _left.pop(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _clear() -> None:
    for path in list(_left):
        with contextlib.suppress(Exception):  # the session may have ended
            _remove(path)
