"""Which source a path or a name means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thriftlens import storage
from thriftlens.sources.database import read_database
from thriftlens.sources.dumps import read_dumps


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def read_session(spark: SparkSession, path: str | None = None, database: str | None = None, dumps: str | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(sessions, messages) of one session, or None.

    No path: the last session of `database`, else the newest of `dumps`. A folder: its newest dump. A .json or
    .db file: what it holds. Else: a session id in `database`, or a dump without the usual ending.
    """
    if path is None:
        if database and storage.exists(spark, database):
            found = read_database(spark, database, latest=True)
            if not found[0].isEmpty():
                return found
        return _newest(spark, dumps) if dumps else None
    path = str(path)
    if path.endswith(".json"):
        return _some(read_dumps(spark, path)) if storage.exists(spark, path) else None
    if path.endswith(".db"):
        return _some(read_database(spark, path, latest=True)) if storage.exists(spark, path) else None
    if _is_dir(spark, path):
        return _newest(spark, path)
    if database and storage.exists(spark, database):
        found = read_database(spark, database, session_id=path)
        if not found[0].isEmpty():
            return found
    return _some(read_dumps(spark, path)) if storage.exists(spark, path) else None


def read_all(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) of every session at a path: a database, or dumps."""
    return read_database(spark, path) if str(path).endswith(".db") else read_dumps(spark, path)


def _newest(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    return _some(read_dumps(spark, folder, latest=True)) if _is_dir(spark, folder) else None


def _some(found: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame] | None:
    return None if found[0].isEmpty() else found
