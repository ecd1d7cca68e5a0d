"""What a proxy in front of the model would count: the same columns in batch and in streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.plans import compress
from thriftlens.schema import DEFAULT

#: Fixed values: $ per 1M input tokens that a saved token of each API is counted with.
RATES = {"chat": 2.50, "messages": 3.0}
STATS = "total_requests long, total_input_tokens_before long, total_input_tokens_after long, total_output_tokens long, estimated_cost_saved double"


def api_of(path: Column) -> Column:
    """Which API a request path belongs to; others aren't counted."""
    return F.when(path.contains("/v1/chat/completions"), "chat").when(path.contains("/v1/messages"), "messages")


_BODY = "model string, stream boolean, messages array<struct<role:string,content:string>>, temperature double, top_p double, frequency_penalty double, presence_penalty double, stop string, tools string, response_format string"


def routed(raw: DataFrame) -> DataFrame:
    """Raw requests (path, body as JSON, other columns) as the request log: api, model, streaming, messages and parameters.

    Requests on other paths are passed on unread: api and what the body holds are null, and stats() doesn't count them.
    A body that isn't JSON counts as one without messages. Works on a stream as well.
    """
    body = F.from_json(F.when(F.col("api").isNotNull(), F.col("body")), _BODY)
    rows = raw.withColumn("api", api_of(F.col("path"))).withColumn("_b", body)
    none = F.array().cast("array<struct<role:string,content:string>>")
    messages = F.when(F.col("api").isNotNull(), F.coalesce("_b.messages", none))
    parameters = {c: F.col(f"_b.{c}") for c in ("temperature", "top_p", "frequency_penalty", "presence_penalty", "stop", "tools", "response_format")}
    return rows.withColumns({"model": F.col("_b.model"), "streaming": F.coalesce("_b.stream", F.lit(False)), "messages": messages} | parameters).drop("_b")


def measured(requests: DataFrame, compressor: str = "none") -> DataFrame:
    """Requests (api, messages, completion_tokens, failed) with before, after and saved of each."""
    small = compress.compressed_contents(F.col("messages"), compress.compressor(compressor))
    size = lambda m: F.floor(F.length(F.to_json(m)) / DEFAULT.chars_per_token).cast("long")
    failed = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in requests.columns else F.lit(False)
    rate = F.when(F.col("api") == "chat", RATES["chat"]).otherwise(RATES["messages"])
    rows = requests.where(F.col("api").isin(*RATES)).withColumn("before", size(F.col("messages"))).withColumn("after", size(small))
    return rows.withColumn("out", F.when(~failed, F.coalesce("completion_tokens", F.lit(0))).otherwise(0)).withColumn(
        "saved", F.when(~failed, (F.col("before") - F.col("after")) / F.lit(1e6) * rate).otherwise(0.0)
    )


def totals() -> list[Column]:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return [
        F.count("*").alias("total_requests"), zero("before").alias("total_input_tokens_before"), zero("after").alias("total_input_tokens_after"),
        zero("out").alias("total_output_tokens"), F.coalesce(F.sum("saved"), F.lit(0.0)).alias("estimated_cost_saved"),
    ]


def stats(requests: DataFrame, compressor: str = "none", by: list[str] | None = None) -> DataFrame:
    """One row, or one per group; also on a stream, where it needs output mode complete."""
    return measured(requests, compressor).groupBy(*(by or [])).agg(*totals())


def ratio(before: Column, after: Column) -> Column:
    """The share of input tokens that compression saved."""
    return F.when(before > 0, F.lit(1.0) - after / before).otherwise(0.0)


def hours(start: Column, now: Column) -> Column:
    """Hours between two epoch times in seconds."""
    return (now - start) / F.lit(3600.0)


def status_line(s: DataFrame) -> DataFrame:
    line = F.format_string("%,d requests, %,d to %,d input tokens (%.1f%% less), $%.4f saved", "total_requests", "total_input_tokens_before", "total_input_tokens_after", ratio(F.col("total_input_tokens_before"), F.col("total_input_tokens_after")) * 100, "estimated_cost_saved")
    return s.select(line.alias("line"))


def save_stats(s: DataFrame, path: str) -> None:
    """One JSON row; dollars to four places."""
    s.withColumn("estimated_cost_saved", F.round("estimated_cost_saved", 4)).coalesce(1).write.mode("overwrite").json(path)


def load_stats(spark, path: str) -> DataFrame:
    """The saved row; a missing or broken file counts as nothing so far."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fresh = spark.createDataFrame([(0, 0, 0, 0, 0.0)], STATS)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return fresh
    found = spark.read.schema(STATS).option("mode", "DROPMALFORMED").json(path).where("total_requests is not null").limit(1)
    return found if found.count() else fresh
