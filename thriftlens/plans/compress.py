"""Rules that shorten a request: long messages are cut, old turns become one line."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thriftlens.functions import text
from thriftlens.schema import DEFAULT

Compress = Callable[[Column], Column]
CompressList = Callable[[list[dict]], list[dict]]
MESSAGES = "array<struct<role:string,content:string>>"
_compressors: dict[str, Compress] = {"none": lambda c: c}
_of_lists: dict[str, CompressList] = {}


def register_compressor(name: str, f: Compress) -> None:
    """A content compressor: Column of text in, Column of text out."""
    _compressors[name] = f


def register_list_compressor(name: str, f: CompressList) -> None:
    """A compressor of whole requests: messages (dicts of role and content) in, messages out, in Python."""
    _of_lists[name] = f


def list_compressors() -> list[str]:
    return sorted({*_compressors, *_of_lists})


def compressor(name: str) -> Compress:
    return _compressors[name]


def cap_messages(messages: DataFrame, most: int = DEFAULT.cap) -> DataFrame:
    return messages.withColumn("content", text.capped(F.coalesce("content", F.lit("")), most))


def compress_history(messages: DataFrame, key: list[str], turns: int = DEFAULT.turns) -> DataFrame:
    """messages (key, idx, role, content) with old turns summed up: key, out_idx, role, content.

    A conversation of more than 2 * turns messages that aren't system's becomes: its system messages, a system
    message that says how much was left out, its last 2 * turns messages.
    """
    rows = messages.select(*key, "idx", "role", "content").withColumn("system", F.coalesce(F.col("role") == "system", F.lit(False)))
    side = W.partitionBy(*key, "system")
    n = messages.where("role is null or role <> 'system'").groupBy(*key).agg(F.count("*").alias("others"))
    marked = rows.join(n, key, "left").withColumn("back", F.row_number().over(side.orderBy(F.desc("idx"))))
    keep = 2 * turns
    long, old = F.coalesce(F.col("others") > keep, F.lit(False)), ~F.col("system") & (F.col("back") > keep)
    place = F.when(long & ~F.col("system"), 2).otherwise(0)
    kept = marked.where(~long | ~old).select(*key, place.alias("place"), "idx", "role", "content")
    gone = marked.where(long & old).groupBy(*key).agg(F.count("*").alias("k"), (F.sum(F.coalesce(F.length("content"), F.lit(0))) + F.greatest(F.lit(0), F.count("content") - 1)).alias("chars"))
    note = F.concat(F.lit("[Previous conversation summarized: "), F.col("k").cast("string"), F.lit(" messages, ~"), F.col("chars").cast("string"), F.lit(" chars]"))
    added = gone.select(*key, F.lit(1).alias("place"), F.lit(0).cast("long").alias("idx"), F.lit("system").alias("role"), note.alias("content"))
    order = W.partitionBy(*key).orderBy("place", "idx")
    both = kept.withColumn("idx", F.col("idx").cast("long")).unionByName(added)
    return both.withColumn("out_idx", (F.row_number().over(order) - 1).cast("long")).select(*key, "out_idx", "role", "content")


def compress_messages(messages: DataFrame, key: list[str], most: int = DEFAULT.cap, turns: int = DEFAULT.turns) -> DataFrame:
    return compress_history(cap_messages(messages, most), key, turns)


def compressed_array(messages: Column, most: int = DEFAULT.cap, turns: int = DEFAULT.turns) -> Column:
    """The same on array<struct<role, content>>, for requests that carry their messages in one row."""
    m = F.transform(messages, lambda x: F.struct(x["role"].alias("role"), text.capped(F.coalesce(x["content"], F.lit("")), most).alias("content")))
    is_system = lambda x: F.coalesce(x["role"] == "system", F.lit(False))
    system, rest = F.filter(m, is_system), F.filter(m, lambda x: ~is_system(x))
    keep = 2 * turns
    old = F.slice(rest, 1, F.greatest(F.size(rest) - keep, F.lit(0)))
    chars = F.aggregate(old, F.lit(0).cast("long"), lambda n, x: n + F.length(x["content"])) + F.size(old) - 1
    note = F.concat(F.lit("[Previous conversation summarized: "), F.size(old).cast("string"), F.lit(" messages, ~"), chars.cast("string"), F.lit(" chars]"))
    short = F.concat(system, F.array(F.struct(F.lit("system").alias("role"), note.alias("content"))), F.slice(rest, F.greatest(F.size(rest) - keep + 1, F.lit(1)), keep))
    return F.when(F.size(rest) > keep, short).otherwise(m)


def compressed_contents(messages: Column, compress: Compress, longer_than: int = DEFAULT.compress_from) -> Column:
    """Each message's content through a compressor if it is long enough."""
    return F.transform(messages, lambda x: F.struct(x["role"].alias("role"), F.when(F.length(x["content"]) > longer_than, compress(x["content"])).otherwise(x["content"]).alias("content")))


def compressed_list(messages: Column, name: str | None) -> Column:
    """A request's messages, shortened by the rules already, through a compressor of whole lists.

    It fails open: without a name, under a name that nobody registered, and where the compressor raises or gives
    something else than messages, a request stays as the rules left it; the other requests are not affected.
    """
    f = _of_lists.get(name) if name else None
    if f is None:
        return messages

    def one(ms):
        if ms is None:
            return None
        before = [{"role": m["role"], "content": m["content"]} for m in ms]
        try:
            return [{"role": m.get("role"), "content": m.get("content")} for m in f([dict(m) for m in before])]
        except Exception as e:  # noqa: BLE001
            logging.getLogger("thriftlens").warning("compressor %s failed: %s", name, e)
            return before

    @F.pandas_udf(MESSAGES)
    def run(each: pd.Series) -> pd.Series:
        return each.map(one)

    return run(messages)
