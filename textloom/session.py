"""Session helpers: shared scratch folder, pinned tables and bounded collection."""

from __future__ import annotations

import gc
import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound for anything that is shipped to every executor or read back to the driver.
MAX_SHIPPED_ROWS = 200_000

_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).

    A temporary folder stands in for it in local mode only: on a cluster each executor would write
    to its own disk, and what is read back would be incomplete.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the application's own folder, which goes when the application ends.

    Inside ``with scratch(spark)`` the path already goes at the end of the block.
    """
    root = f"{shared_folder(spark)}/textloom/{spark.sparkContext.applicationId}"
    folder, fs = _hadoop_path(spark, root)
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables pinned inside the block when it ends; results must be written or collected before.

    Shuffle files of the block's jobs go too: Spark drops them when the driver collects garbage, which is asked for here.
    """
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            place, fs = _hadoop_path(spark, path)
            fs.delete(place, True)
        # Python objects in cycles hold plans, and these their shuffles.
        gc.collect()
        spark._jvm.System.gc()


def pin(df: DataFrame, name: str = "pin", partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of iterative jobs and fixes row placement; survives lost executors.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a small scan of few files one partition per core; a large scan stays as it is.

    The check reads the plan only. On a large table the scan already has more partitions than
    cores and nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parts_of(df: DataFrame, size: Column, most: int) -> int:
    """Number of partitions that hold about ``most`` of the summed ``size`` each, one per core at least.

    For steps that build much more in memory than they read: partitions chosen by what is read
    (adaptive execution) would grow with the input until they spill.
    """
    total = df.agg(F.sum(size).alias("n")).first()["n"] or 0
    return max(math.ceil(total / most), df.sparkSession.sparkContext.defaultParallelism)


def scalar(df: DataFrame, *cols: Column) -> Column:
    """One-row aggregate as a scalar subquery (a struct when several columns are given)."""
    if len(cols) == 1:
        return df.select(cols[0].alias("_s")).scalar()
    return df.select(F.struct(*cols).alias("_s")).scalar()


def collect_bounded(df: DataFrame, limit: int = MAX_SHIPPED_ROWS, what: str = "table"):
    """Collect a table that must stay small; refuse when it exceeds ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it must not be collected")
    return rows
