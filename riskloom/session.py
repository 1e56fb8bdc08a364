"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Working folders of this driver, oldest first.
_FOLDERS: list[str] = []


def build_session(app: str = "riskloom", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings the operators are tested under.

    Shuffle partitions are left to the cluster: AQE coalesces them, and a fixed number that suits one
    data size is wrong for the next.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder below the one the cluster names in ``spark.checkpoint.dir``.

    Every executor has to see it. Where that setting is missing the warehouse folder, which a cluster shares
    as well, takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
        if not warehouse or not _shared(spark, warehouse):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(warehouse, "_riskloom")
    folder = os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")
    _FOLDERS.append(folder)
    return folder


def _shared(spark: SparkSession, folder: str) -> bool:
    """Whether executors see a folder; one on a local disk only in local mode, where they run on the driver's machine."""
    if spark.sparkContext.master.startswith("local"):
        return True
    scheme = folder.split(":", 1)[0] if ":" in folder else ""
    return (scheme or spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:").split(":", 1)[0]) != "file"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back.

    For a table that several jobs or branches of a plan read; unlike a cache it outlives lost executors.
    """
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Remove the working tables made inside the block once it ends; results have to be written by then."""
    before = len(_FOLDERS)
    try:
        yield
    finally:
        mine, _FOLDERS[before:] = _FOLDERS[before:], []
        for folder in mine:
            discard(spark, folder)


def discard(spark: SparkSession, folder: str) -> None:
    """Remove one working folder, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
