"""Token ids in ORC files: encoded once, written in order of doc_id, read back by stripes.

Documents are range-partitioned and sorted by id, encoded there, and each partition is written as one ORC file:
integer columns are run-length encoded, stripes and row groups have indexes with the least and greatest value,
and doc_id has a Bloom filter, so a reader of one document skips stripes and row groups, and a reader of all
takes stripes in parallel. A row holds the document's place in its part (`before`: ids of the part before it);
a part's own start is a prefix sum over one row per part, read from the files' `before` and `n_tokens` alone.

Encoding is the tokenizers library's. The words of plain Latin texts repeat, so each worker remembers what the
library gave for a bounded number of them (cut where its pre-tokenizer cuts too); any other text, and one that
holds a special token's string, is given to the library whole.

Defined results: null text is an empty text: only the end id. A very long text is encoded whole and is one row. Null
ids come first; equal ids, with equal or different texts, stay in the order of the input. No rows: empty files. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thriftlens.storage import fresh_path

from .common import column, mapped, raw, shipped, small_batches, written
from .wordcache import WordCache, plain, spread

END = 2


class Encoder:
    """The library's ids of texts, by a tokenizer file's bytes; literal: special tokens' strings are plain text."""

    def __init__(self, content: bytes, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(content)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = literal
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.spaced = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.words = WordCache(self.ask)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def ask(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of chunks, end to end, and how many each has.

        Chunks that begin with their only space are given to it as one text, whose ids are cut at spaces.
        """
        n = np.zeros(len(chunks), np.int64)
        one = [i for i, c in enumerate(chunks) if c[0] == 32 and len(c) > 1]
        rest = [i for i, c in enumerate(chunks) if c[0] != 32 or len(c) == 1]
        order, flat = [], []
        for begin in range(0, len(one), 20_000):
            part = one[begin : begin + 20_000]
            ids = self.whole([b"".join([chunks[i] for i in part]).decode("utf-8", "replace")])[0]
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != len(part) or starts[0] != 0:
                rest += part
                continue
            n[part] = np.diff(np.append(starts, len(ids)))
            order += part
            flat.append(ids)
        for i, ids in zip(rest, self.whole([chunks[i].decode("utf-8", "replace") for i in rest])):
            n[i] = len(ids)
            flat.append(ids)
        order += rest
        at = np.empty(len(chunks), np.int64)
        at[order] = np.cumsum(n[order]) - n[order]
        flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        return flat[spread(at, n)], n

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        odd, usual = [], []
        for i, t in enumerate(texts):
            if t:
                (usual if plain(t) and not any(s in t for s in self.special) else odd).append(i)
        for i, ids in zip(odd, self.whole([texts[i].decode("utf-8", "replace") for i in odd])):
            out[i] = ids
        for i, ids in zip(usual, self.words.ids_of([texts[i] for i in usual])):
            out[i] = ids
        return out


_LOADED: dict[str, Encoder] = {}


def encoder(content: bytes) -> Encoder:
    """One for each Python worker and file."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Encoder(content)
    return _LOADED[key]


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> None:
    """ORC files at path: part, before, doc_id, n_tokens, ids, in ascending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("tie"))
    ranged = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    end, shared = np.array([END], np.int32), shipped(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, total = encoder(shared.value), 0
        for b in batches:
            ids = e.encode([t or b"" for t in raw(b)])
            n = np.array([len(x) + 1 for x in ids], np.int64)
            upto = np.cumsum(n)
            flat = np.concatenate([y for x in ids for y in (x, end)]) if ids else end[:0]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([column(b, "part"), pa.array(upto - n + total), column(b, "doc_id"), pa.array(n), lists], ["part", "before", "doc_id", "n_tokens", "ids"])
            total += int(upto[-1]) if len(n) else 0

    out = mapped(ranged, run, "part int, before long, doc_id long, n_tokens long, ids array<int>")
    out.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.row.index.stride", "1000").option("compression", "zstd").orc(path)


SCHEMA = "part int, before long, doc_id long, n_tokens long, ids array<int>"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; filters on doc_id are pushed down to row-group indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part, start: how many ids come before each part; one row per part."""
    parts = read_tokens(spark, path).groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n"))
    return parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    offsets = written(starts(spark, path).withColumnRenamed("start", "part_start"), "starts")
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = column(b, "ids")
            at = ids.offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(flat[4 * x : 4 * y]) for x, y in zip(at.tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([column(b, "part"), column(b, "before"), column(b, "doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], ["part", "before", "doc_id", "n_tokens", "ids_crc32"])

    rows = mapped(read_tokens(spark, path).select("part", "before", "doc_id", "ids"), run, "part int, before long, doc_id long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("part_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files to the shared folder and read them back."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_tokens(docs, tokenizer, path)
    return read_back(spark, path)
