"""The cache at a path: hash-bucketed files behind a pointer, so a write costs its buckets and a crash costs nothing.

    path/data-<version>-<id>/bucket=<n>/...   entries, in files by bucket of the key's hash; never changed once written
    path/current-<version>                    the pointer: which folder holds each bucket that has entries

A write puts new folders beside the old ones and then names them in a pointer of the next version, in one rename. A
reader takes the pointer of the greatest version. So whoever is stopped at any step leaves the cache as it was, with at
most a folder that nothing names; the next write of that version replaces it. Folders that neither the new pointer nor
the one before it names are deleted after the rename, so a reader that has just opened the one before can go on. One
writer at a time: of two that meet, the second one's rename fails, and it can be tried again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftlens.schema import RESPONSES

BUCKETS = 256


class CacheConflict(Exception):
    """Another writer has named this version first."""


def bucket_of(key: str | Column = "key") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Of the pointers that are there, ascending."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.removeprefix("current-")) for n in names if n.startswith("current-"))


def pointed(spark: SparkSession, path: str, version: int) -> dict[int, str]:
    """Folder by bucket, as a pointer names them: BUCKETS short lines at most."""
    rows = spark.read.text(f"{path}/current-{version}").collect()
    return {int(b): folder for b, folder in (r[0].split("\t") for r in rows if r[0])}


def _point(spark: SparkSession, path: str, version: int, folders: dict[int, str]) -> None:
    """Name the folders of a version, in one rename."""
    fs, new = _fs(spark, f"{path}/.next-{version}")
    out = fs.create(new, True)
    out.write(bytearray("".join(f"{b}\t{f}\n" for b, f in sorted(folders.items())), "utf-8"))
    out.close()
    _, to = _fs(spark, f"{path}/current-{version}")
    if fs.exists(to) or not fs.rename(new, to):
        raise CacheConflict(f"{path}: version {version} is there already")


def _write(entries: DataFrame, path: str, version: int) -> dict[int, str]:
    """Entries as bucket folders of a new version."""
    spark, name = entries.sparkSession, f"data-{version}-{uuid.uuid4().hex}"
    entries.withColumn("bucket", bucket_of()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
    fs, p = _fs(spark, f"{path}/{name}")
    found = [s.getPath().getName() for s in fs.listStatus(p)]
    return {int(n.removeprefix("bucket=")): f"{name}/{n}" for n in found if n.startswith("bucket=")}


def _swept(spark: SparkSession, path: str, keep: set[str], pointers: list[int]) -> None:
    """Delete the bucket folders that no kept pointer names, and older pointers."""
    fs, p = _fs(spark, path)
    for v in pointers:
        fs.delete(_fs(spark, f"{path}/current-{v}")[1], False)
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if not name.startswith("data-"):
            continue
        buckets = [b.getPath() for b in fs.listStatus(s.getPath())]
        live = [b for b in buckets if f"{name}/{b.getName()}" in keep]
        if not live:
            fs.delete(s.getPath(), True)
        for b in buckets if live else []:
            if b.getName().startswith("bucket=") and f"{name}/{b.getName()}" not in keep:
                fs.delete(b, True)


def _commit(spark: SparkSession, path: str, seen: list[int], version: int, folders: dict[int, str]) -> None:
    _point(spark, path, version, folders)
    before = set(pointed(spark, path, seen[-1]).values()) if seen else set()
    _swept(spark, path, before | set(folders.values()), seen[:-1])


def open_cache(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The cache at a path, or only some buckets of it; empty if nothing was stored there."""
    seen = versions(spark, path)
    folders = pointed(spark, path, seen[-1]) if seen else {}
    read = [f"{path}/{f}" for b, f in sorted(folders.items()) if buckets is None or b in buckets]
    return spark.read.schema(RESPONSES).parquet(*read) if read else spark.createDataFrame([], RESPONSES)


def save_cache(cache: DataFrame, path: str) -> None:
    """Replace the whole cache."""
    spark = cache.sparkSession
    seen = versions(spark, path)
    version = seen[-1] + 1 if seen else 0
    _commit(spark, path, seen, version, _write(cache.select("key", "model", "response", "created_at", "hits"), path, version))


def upsert(entries: DataFrame, path: str) -> list[int]:
    """Write entries (key, model, response, created_at) into the cache; the buckets that were rewritten.

    Only the buckets of the entries' keys are read and written; other keys of theirs keep their hits.
    """
    from thriftlens.plans.requests import merged

    spark = entries.sparkSession
    touched = sorted(r[0] for r in entries.select(bucket_of()).distinct().collect())  # BUCKETS at most
    if not touched:
        return []
    seen = versions(spark, path)
    version = seen[-1] + 1 if seen else 0
    folders = pointed(spark, path, seen[-1]) if seen else {}
    new = _write(merged(open_cache(spark, path, touched), entries), path, version)
    _commit(spark, path, seen, version, {b: f for b, f in folders.items() if b not in touched} | new)
    return touched


def clear_cache(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)
