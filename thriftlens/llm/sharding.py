"""Contiguous shards of nearly equal bytes, by a global prefix sum of sizes cut at equal targets.

Rows (id, size and checksum; never the text) are range-partitioned by id and sorted; a running sum inside each
partition and the partitions' totals, one row each, give every document its place in the order of all bytes.
The shard is that of the document's middle byte, so a shard's size is off by half a document at each end.
There is one shuffle, of about 40 bytes a row. Range bounds split ties (equal ids, repeated rows) by a row
number, so no key is hot. The written table ends the lineage: bounds are sampled once.

Defined results: null text counts 0 bytes (plus the fixed bytes of a row) and has the checksum of no bytes.
A very long text is one row, never cut, so its shard may be that much larger. Null ids come first; rows of equal id
(repeated rows, or several texts) go by checksum, size and position. No rows, no shards; with fewer documents than
shards some shards are empty. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, mapped, written

FIXED_BYTES = 8


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, part, before (bytes before it in its part), nth (its place in its part)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + FIXED_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    key = ["doc_id", "text_crc32", "size", "tie"]
    ranged = rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = n = 0
        for b in batches:
            size = column(b, "size").to_numpy()
            upto = np.cumsum(size) + total
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("doc_id", "size", "text_crc32", "part")), pa.array(upto - size), pa.array(np.arange(len(size)) + n)], ["doc_id", "size", "text_crc32", "part", "before", "nth"])
            total, n = (int(upto[-1]) if len(size) else total), n + len(size)

    return written(mapped(ranged.drop("tie"), run, "doc_id long, size long, text_crc32 long, part int, before long, nth long"), "placed")


def sharded(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row of docs."""
    rows = placed(docs)
    parts = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))  # one row per partition
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.sum("bytes").over(W.partitionBy()).alias("total"))
    offsets = written(offsets, "offsets")
    at = rows.join(F.broadcast(offsets), "part").withColumn("row", F.col("n0") + F.col("nth"))
    shard = F.expr(f"cast(least((2 * (bytes0 + before) + size) * {shards} div (2 * total), {shards - 1}) as int)")
    at = at.withColumn("shard", shard)
    first = written(at.groupBy("shard").agg(F.min("row").alias("row0")), "first")  # one row per shard
    return at.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("row0")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
