"""The request path over a log: normalize, look up, compress, account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.functions import pricing, text
from thriftlens.plans import compress
from thriftlens.plans.cache import clear_cache, open_cache, save_cache, upsert
from thriftlens.schema import DEFAULT
from thriftlens.storage import small_batches

MESSAGE = "array<struct<role:string,content:string>>"


def json_size(messages: Column) -> Column:
    """Characters of the messages as JSON."""
    return F.length(F.to_json(messages))


def keyed(requests: DataFrame) -> DataFrame:
    """Requests with normalized messages and their cache key; `cacheable` where the cache is asked at all."""
    small_batches(requests.sparkSession)
    params = {p: F.col(p) for p in text.KEY_PARAMS if p in requests.columns}
    # from the messages as they came, which are null where normalized ones are: a filter then needs no second Python worker
    rows = requests.withColumn("cacheable", F.col("messages").isNotNull() & ~F.coalesce("streaming", F.lit(False)))
    rows = rows.withColumn("messages", text.normalized(F.col("messages")))
    rows = rows.withColumn("key", text.cache_key(F.coalesce("model", F.lit("")), F.col("messages"), params))
    return rows.select(*[c for c in rows.columns if c != "cacheable"], "cacheable")


def replayed(rows: DataFrame) -> DataFrame:
    """keyed() with is_hit: the first cacheable request of a key misses and is stored, later ones hit.

    The first is an aggregate over (ts, request_id) with a map-side part, joined back by its request_id, which tells
    the requests of a log apart: a popular key is no group in one task, and messages aren't sorted.
    """
    cacheable = rows.where("cacheable")
    first = cacheable.groupBy("key").agg(F.min(F.struct("ts", "request_id")).alias("first")).select(F.col("key").alias("_key"), F.col("first.request_id").alias("_first"), F.col("first.ts").alias("_at"), F.lit(False).alias("_hit"))
    on = F.col("cacheable") & (F.col("key") == F.col("_key")) & F.col("request_id").eqNullSafe(F.col("_first")) & F.col("ts").eqNullSafe(F.col("_at"))
    return rows.join(first, on, "left").withColumn("is_hit", F.col("cacheable") & F.coalesce("_hit", F.lit(True))).drop("_key", "_first", "_at", "_hit")


def savings(rows: DataFrame, cap: int = DEFAULT.cap, turns: int = DEFAULT.turns) -> DataFrame:
    """replayed() with compressed messages, tokens_before and tokens_saved.

    A hit saves the whole response's tokens (estimated from its text where usage isn't known); a miss saves
    what the request was larger than the prompt tokens that were billed.
    """
    before = F.greatest(F.lit(1), F.floor(json_size(F.col("messages")) / DEFAULT.chars_per_token)).cast("long")
    response = F.greatest(F.lit(1), F.floor(F.length(F.coalesce("response", F.lit(""))) / DEFAULT.chars_per_token)).cast("long") if "response" in rows.columns else F.lit(1).cast("long")
    hit = F.when(F.col("total_tokens") > 0, F.col("total_tokens")).otherwise(response)
    miss = F.when(F.col("prompt_tokens").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("tokens_before") - F.col("prompt_tokens"))).otherwise(0)
    rows = rows.withColumn("tokens_before", before)
    return rows.withColumn("compressed", F.when(~F.col("is_hit"), compress.compressed_array(F.col("messages"), cap, turns))).withColumn("tokens_saved", F.when(F.col("is_hit"), hit).otherwise(miss))


def optimized(requests: DataFrame, cap: int = DEFAULT.cap, turns: int = DEFAULT.turns, whole: str | None = None) -> DataFrame:
    """The whole path, one row per request; `whole` names a compressor of whole message lists, which goes after the rules."""
    rows = savings(replayed(keyed(requests)), cap, turns)
    return rows if whole is None else rows.withColumn("compressed", compress.compressed_list(F.col("compressed"), whole))


def run_summary(rows: DataFrame) -> DataFrame:
    """calls, hits, tokens_saved, cost_saved, line: totals of optimized()."""
    per = rows.agg(F.count("*").alias("calls"), F.count_if("is_hit").alias("hits"), F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("tokens_saved"))
    per = per.withColumn("cost_saved", pricing.saved_cost(F.col("tokens_saved")))
    line = F.concat(F.format_string("%d calls, %d cache hits, ~%,d tokens saved", "calls", "hits", "tokens_saved"), F.when(F.col("cost_saved") >= 0.01, F.format_string(" (~$%.2f)", "cost_saved")).otherwise(""))
    return per.withColumn("line", F.when(F.col("calls") > 0, line))


# --- the cache as a table: key, model, response, created_at, hits --------------------------------------------


def stored(entries: DataFrame) -> DataFrame:
    """The cache after a list of writes (key, model, response, created_at): the last of a key stays, with one hit."""
    last = entries.groupBy("key").agg(F.max_by(F.struct("model", "response", "created_at"), F.struct("created_at", "response")).alias("e"))
    return last.select("key", "e.model", "e.response", "e.created_at", F.lit(1).cast("long").alias("hits"))


def merged(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """cache with new entries written into it; other keys keep their hits."""
    new = stored(entries)
    return cache.join(new, "key", "left_anti").unionByName(new)


def looked_up(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """keyed() rows with the cached response of their key, or null."""
    return rows.join(cache.select("key", "response"), "key", "left")


def counted(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """cache after lookups of rows: each finds its entry and adds a hit."""
    found = rows.where("cacheable").groupBy("key").agg(F.count("*").alias("more"))
    return cache.join(found, "key", "left").withColumn("hits", F.col("hits") + F.coalesce("more", F.lit(0))).select(*cache.columns)


def replayed_cache(rows: DataFrame) -> DataFrame:
    """key, model, hits of a cache that began empty and saw replayed() rows."""
    return rows.where("cacheable").groupBy("key").agg(F.min("model").alias("model"), F.count("*").alias("hits"))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("exact_entries"), F.coalesce(F.sum(F.col("hits") - 1), F.lit(0)).cast("long").alias("exact_repeat_hits"))


__all__ = [
    "cache_stats", "clear_cache", "counted", "json_size", "keyed", "looked_up", "merged", "open_cache", "optimized", "replayed", "replayed_cache", "run_summary", "save_cache", "savings", "stored", "upsert",
]
