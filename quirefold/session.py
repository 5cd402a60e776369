"""Session and table helpers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quirefold")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a scale-factor folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def scratch_path(spark: SparkSession) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or a temporary one in local mode without it."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared}/scratch-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """path with the file system that Spark takes it to be in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders, in whatever file system they are."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def tables(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Gives ``save(df, keep=False)``, which writes df to the shared folder and reads it again, so that lineage ends there.

    The folders are deleted at the end, but for those saved with keep, which the result still reads.
    """
    mine: list[str] = []

    def save(df: DataFrame, keep: bool = False) -> DataFrame:
        path = scratch_path(spark)
        df.write.parquet(path)
        if not keep:
            mine.append(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield save
    finally:
        removed(spark, *mine)
