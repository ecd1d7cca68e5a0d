"""Request dumps (JSON files, one session each) as sessions and messages."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thriftlens.schema import CALLS, DEFAULT

_MESSAGE = f"array<struct<role:string,content:string,tool_name:string,tool_call_id:string,token_count:long,tool_calls:{CALLS}>>"
INDEX_FILE = "sessions.json"


def session_id(file_name: Column) -> Column:
    """The stem; of request_dump_A_B_C_... it is A_B_C."""
    stem = F.regexp_replace(file_name, r"\.[^.]*\z", "")
    parts = F.split(F.replace(stem, F.lit("request_dump_"), F.lit("")), "_")
    return F.when(stem.startswith("request_dump_") & (F.size(parts) >= 3), F.array_join(F.slice(parts, 1, 3), "_")).otherwise(stem)


@F.pandas_udf(T.LongType())
def _json_chars(messages: pd.Series) -> pd.Series:
    """Characters of each message written as JSON with ", " and ": " and escapes, added up."""
    return messages.map(lambda x: sum(len(json.dumps(m)) for m in json.loads(x)), na_action="ignore")


def read_dumps(spark: SparkSession, path: str, latest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) of the dumps at a path (file, folder or pattern); `latest` takes the newest file.

    Files that don't hold a JSON object are left out. A body that is itself a string of JSON is read through;
    a broken one is empty.
    """
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(str(path)).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("at"))
    files = files.where(F.col("file") != INDEX_FILE)
    if latest:
        newest = files.select("file", "at").orderBy(F.desc("at"), "file").limit(1)
        files = files.join(F.broadcast(newest.select("file")), "file")
    whole = F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT")
    body = F.get_json_object("value", "$.request.body")
    rows = files.where(whole).select(session_id(F.col("file")).alias("session_id"), F.coalesce(F.get_json_object(body, "$.model"), F.lit("unknown")).alias("model"), F.get_json_object(body, "$.messages").alias("m"))
    rows = rows.withColumn("messages", F.coalesce(F.from_json("m", _MESSAGE), F.array().cast(_MESSAGE)))
    calls = F.aggregate("messages", F.lit(0).cast("long"), lambda n, x: n + F.when(x["role"] == "assistant", F.coalesce(F.size(x["tool_calls"]), F.lit(0))).otherwise(0))
    chars = F.coalesce(_json_chars("m"), F.lit(0))
    sessions = rows.select(
        "session_id", "model", F.size("messages").cast("long").alias("message_count"), calls.alias("tool_call_count"),
        F.greatest(F.lit(1), F.floor(chars / DEFAULT.chars_per_token)).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"),
        F.lit(0.0).alias("cost_usd"), F.lit("").alias("started_at"), F.lit("json").alias("source"),
    )
    each = rows.select("session_id", F.posexplode("messages").alias("idx", "x"))
    messages = each.select(
        "session_id", F.col("idx").cast("long"), "x.role", "x.content", "x.tool_name", "x.tool_call_id", "x.token_count", "x.tool_calls", F.lit(None).cast("string").alias("tool_calls_raw")
    )
    return sessions, messages
