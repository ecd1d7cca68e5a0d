"""Shared pieces of the corpus operators: the shared folder, written tables, Arrow batches."""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftlens.storage import fresh_path, importable, small_batches

#: Python's and this project's ASCII white space: space, and U+0009 to U+000D.
WHITE = r"[\x20\x09-\x0D]"
#: One word of a text.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and lost executors don't matter."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._thriftlens_path = path
    if _scopes():
        _scopes()[-1].append(table)
    return table


_local = threading.local()


def _scopes() -> list[list[DataFrame]]:
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written inside are deleted at the end, but for those given to the function that this yields.

    Those are what a lazy result still reads; they belong to the scope around this one, if there is one, and else stay
    until the application ends.
    """
    kept: list[DataFrame] = []
    _scopes().append([])

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        for t in _scopes().pop():
            if not any(t is k for k in kept):
                dropped(t)
        if _scopes():
            _scopes()[-1].extend(kept)


def dropped(table: DataFrame | None) -> None:
    """Delete a table made by written(), once nothing reads it any more."""
    path = getattr(table, "_thriftlens_path", None)
    if path:
        spark = table.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def shipped(spark: SparkSession, path: str):
    """A broadcast of a file's bytes (a tokenizer's, a few MB): only the driver has to reach it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def raw(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a text column."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def in_groups(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into slices of at most `most` bytes (a longer text is alone)."""
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys from batches that are sorted by them; one table for each key, never two keys at once."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [column(batch, k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task, and many kinds of task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches bounded by bytes."""
    small_batches(df.sparkSession)
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def unused_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Links that are contracted at once (4 MB, and several times that while it lasts).
CHUNK = 250_000


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node of each one's component) of links u, v."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        # a link lowers both ends and the nodes that stand for them
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, least)
        while not np.array_equal(again := new[new], new):
            new = again
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contracted(links: DataFrame, chunk: int) -> DataFrame:
    """contracted() as a table."""
    with scratch() as keep:
        return keep(written(contracted(links, chunk), "links"))


def contracted(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) that connect the same nodes: in each chunk of a partition, every node with the least one it reaches.

    The links are written first and then read by as many tasks as there are chunks, so that a chunk is full however finely
    they were dealt: few links, in many parts, need no steps between the parts.
    """
    links = written(links, "loose")
    links = links.coalesce(max(1, -(-links.count() // chunk)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def stars() -> pa.RecordBatch:
            nodes, least = least_reached(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            more = nodes != least
            return pa.RecordBatch.from_arrays([pa.array(nodes[more]), pa.array(least[more])], ["u", "v"])

        n = 0
        for b in batches:
            u, v = column(b, "u").to_numpy(), column(b, "v").to_numpy()
            for i in range(0, len(u), chunk):
                held.append((u[i : i + chunk], v[i : i + chunk]))
                n += len(held[-1][0])
                if n >= chunk:
                    yield stars()
                    held, n = [], 0
        if held:
            yield stars()

    return mapped(links.select(F.col("u").cast("long"), F.col("v").cast("long")), run, "u long, v long").distinct()


def components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Connected components of links (a, b): rows (node, comp), comp the smallest node of each.

    Chunks of links are contracted where they lie; then large-star and small-star steps rewire links to the least
    neighbour, each followed by a contraction, until all links are stars whose centres have no link of their own. That
    is seen from one aggregate over the nodes. Nodes without a link don't appear. Every step's minima are written
    first, so that the join with them has exchanges on both sides and Spark can split a node that has very many links.
    """
    e = _contracted(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), chunk)
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = written(both.join(least.hint("merge"), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least2 = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least2.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = _contracted(small.unionByName(least2.select("u", F.col("m").alias("v"))), chunk)
        for t in (least, large, least2, e):
            dropped(t)
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether each node of links (u, v) has one link up, or only links from below."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").limit(1).count()
