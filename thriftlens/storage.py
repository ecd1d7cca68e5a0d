"""Folders that every executor sees."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master without it, a folder of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='thriftlens-')}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package, wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


def small_batches(spark: SparkSession, mb: int = 4) -> None:
    """Bound an Arrow batch by bytes, so that a run of long texts can't fill a Python worker.

    Plans read this setting of the session when they run, so it stays; a smaller one of the user's stays too.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > mb << 20:
        spark.conf.set(name, str(mb << 20))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nobody has used; what is there when the application ends is deleted."""
    path = f"{shared_dir(spark)}/thriftlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: what reads it reads only the columns it needs."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    if getattr(_local, "scopes", None):
        _local.scopes[-1].append(table)
    return table


_local = threading.local()


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that this thread writes inside are deleted at the end, but for those given to the function that this yields."""
    kept: list[DataFrame] = []
    _local.scopes = [*getattr(_local, "scopes", []), []]

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        for t in _local.scopes.pop():
            if not any(t is k for k in kept):
                dropped(t)
        if _local.scopes:
            _local.scopes[-1].extend(kept)


def dropped(table: DataFrame) -> None:
    """Delete a table made by written(), once nothing reads it any more."""
    if path := getattr(table, "_written_at", None):
        p = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
