"""Paths and written tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The folder below the shared one that new paths lie in; ``passing`` puts others in its place.
_FOLDERS = ["wayfarer-work"]


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, which the driver and all executors share.

    Only on one machine, where it may be unset, a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wayfarer-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``clean_scratch`` removes them all."""
    return f"{shared_dir(spark)}/{_FOLDERS[-1]}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back, which cuts its lineage.

    Files in the shared folder outlive lost executors, so nothing upstream is run
    again, and all readers see the same rows in the same files.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark reaches; nothing happens where there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is written to the shared folder inside the block goes at its end.

    Frames that still read it become invalid, so the block's result must have been
    written elsewhere by then.
    """
    folder = f"wayfarer-work/{uuid.uuid4().hex}"
    _FOLDERS.append(folder)
    try:
        yield
    finally:
        _FOLDERS.remove(folder)
        deleted(spark, f"{shared_dir(spark)}/{folder}")


def clean_scratch(spark: SparkSession) -> None:
    """Delete all that was written to the shared folder; frames that still read it become invalid."""
    deleted(spark, f"{shared_dir(spark)}/wayfarer-work")
