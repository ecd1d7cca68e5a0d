"""The request path as streams: totals, windows and cache replay, equal to the batch plans."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from thriftlens import storage
from thriftlens.plans import accounting, cache, requests
from thriftlens.schema import REQUESTS


def request_log(spark: SparkSession, path: str, schema: str = REQUESTS, form: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    """A growing folder of request files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(form).load(path)


def stats(stream: DataFrame, compressor: str = "none") -> DataFrame:
    """Totals since the stream began; use output mode complete. The state is one row."""
    return accounting.stats(stream, compressor)


def stats_by_window(stream: DataFrame, window: str = "5 minutes", late: str = "10 minutes", compressor: str = "none") -> DataFrame:
    """Totals by window of event time, final once the watermark has passed. An addition to the batch totals."""
    rows = accounting.measured(stream.withWatermark("ts", late), compressor)
    return rows.groupBy(F.window("ts", window)).agg(*accounting.totals()).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *accounting.STATS.replace(" long", "").replace(" double", "").split(", "))


class Replay:
    """Cache replay of a stream: request_id, key, is_hit of each cacheable request, at `path`/out.

    A key that was never seen misses once, then hits. Within a micro-batch requests go by (ts, request_id), in whatever
    order they come. Each micro-batch is a plan of built-in functions, without state in Python: the first request of each
    key is a minimum with a map-side part; keys that are known already are left out by an anti-join; what remains is
    written as the batch's new keys and joined back by request, so a popular key is no group in one task.

    Known keys are kept as in a log: a small table for each micro-batch, and every `compact` batches one that holds all
    before, in folders by bucket of the key's hash; a micro-batch reads only the buckets of its own keys. Tables are named
    by the number of their micro-batch and replaced whole, and a batch reads only those of earlier ones. So a micro-batch
    that runs again, after a crash or from a checkpoint, gives the same rows.
    """

    def __init__(self, path: str, compact: int = 32):
        self.path, self.compact = path, compact

    def out(self, spark: SparkSession) -> DataFrame:
        """All rows so far."""
        schema = "request_id long, key string, is_hit boolean"
        done = [f"{self.path}/out/batch={n}" for n in self._complete(spark, "out", "batch=")]
        return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)

    def _complete(self, spark: SparkSession, table: str, prefix: str) -> list[int]:
        """Numbers of a table's parts that were written to the end."""
        fs, p = cache._fs(spark, f"{self.path}/{table}")
        if not fs.exists(p):
            return []
        parts = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith(prefix)]
        done = lambda x: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))
        return sorted(int(x.getName().removeprefix(prefix)) for x in parts if done(x))

    def known(self, spark: SparkSession, before: int, buckets: list[int]) -> DataFrame:
        """The keys of micro-batches before this one, in some buckets."""
        base = max((n for n in self._complete(spark, "known", "upto=") if n < before), default=-1)
        later = [f"{self.path}/known/batch={n}" for n in self._complete(spark, "known", "batch=") if base < n < before]
        none = spark.range(0).select(F.lit(None).cast("string").alias("key"))  # without a Python worker for each task
        out = spark.read.schema("key string").parquet(*later) if later else none
        if base >= 0:
            held = spark.read.schema("key string, bucket int").parquet(f"{self.path}/known/upto={base}")
            out = out.unionByName(held.where(F.col("bucket").isin(buckets)).select("key"))
        return out

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = requests.keyed(batch).where("cacheable").select("key", "request_id", "ts").persist()
        try:
            first = rows.groupBy("key").agg(F.min(F.struct("ts", "request_id")).alias("first"))
            buckets = [r[0] for r in rows.select(cache.bucket_of()).distinct().collect()]  # BUCKETS at most
            new = first.join(self.known(spark, number, buckets), "key", "left_anti").select("key", "first.ts", "first.request_id")
            new.write.mode("overwrite").parquet(f"{self.path}/known/batch={number}")
            new = spark.read.schema(new.schema).parquet(f"{self.path}/known/batch={number}").withColumnsRenamed({"key": "_key", "ts": "_ts", "request_id": "_id"})
            same = (F.col("key") == F.col("_key")) & F.col("request_id").eqNullSafe(F.col("_id")) & F.col("ts").eqNullSafe(F.col("_ts"))
            hits = rows.join(new, same, "left").select("request_id", "key", F.col("_key").isNull().alias("is_hit"))
            hits.write.mode("overwrite").parquet(f"{self.path}/out/batch={number}")
            if number % self.compact == self.compact - 1:
                self._compacted(spark, number)
        finally:
            rows.unpersist()

    def _compacted(self, spark: SparkSession, number: int) -> None:
        """One table of all keys so far, then without the tables that it holds and no micro-batch can read again."""
        everything = self.known(spark, number + 1, list(range(cache.BUCKETS))).distinct()
        bucketed = everything.withColumn("bucket", cache.bucket_of()).repartition("bucket").sortWithinPartitions("bucket", "key")
        bucketed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/known/upto={number}")
        fs, _ = cache._fs(spark, self.path)
        bases = self._complete(spark, "known", "upto=")
        # the batch itself may run again and reads what came before it, so the base before this one stays, and its later parts
        kept = bases[-2] if len(bases) > 1 else -1
        for n in self._complete(spark, "known", "batch="):
            if n <= kept:
                fs.delete(cache._fs(spark, f"{self.path}/known/batch={n}")[1], True)
        for n in bases[:-2]:
            fs.delete(cache._fs(spark, f"{self.path}/known/upto={n}")[1], True)


def replay(stream: DataFrame, path: str, checkpoint: str, compact: int = 32, **trigger) -> StreamingQuery:
    """Start a cache replay whose rows and known keys are kept at path; read them with Replay(path).out(spark)."""
    return stream.writeStream.foreachBatch(Replay(path, compact)).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "10 seconds"}).start()


def replayed(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Run a cache replay over what is there now and read its rows."""
    spark = stream.sparkSession
    path = path or storage.fresh_path(spark, "replay")
    replay(stream, path, f"{path}/checkpoint", availableNow=True).awaitTermination()
    return Replay(path).out(spark)


def finished(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what is there now and read its last result."""
    return finished_each(iter([stream]), mode, name)


def finished_each(runs: Iterator[DataFrame], mode: str, name: str) -> DataFrame:
    """Run a stream again and again, from where it was, over what has come until each run, and read its last result."""
    out = checkpoint = stream = None
    for stream in runs:
        spark = stream.sparkSession
        if out is None:
            out, checkpoint = storage.fresh_path(spark, f"{name}-out"), storage.fresh_path(spark, f"{name}-state")
        write = lambda df, epoch: df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)  # noqa: E731, ARG005
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out) if storage.exists(spark, out) else spark.createDataFrame([], stream.schema)
