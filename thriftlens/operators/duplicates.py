"""Repeated tool calls: equal arguments, or one tool very often."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thriftlens.functions import text
from thriftlens.operators.tables import Tables, finding, plural, with_response_tokens


def exact_groups(t: Tables) -> DataFrame:
    """session_id, name, norm_args, n, first_pos, resp, wasted of calls made twice or more with equal arguments."""
    calls = t.tool_calls().withColumn("norm_args", text.canonical_arguments("arguments"))
    groups = calls.groupBy("session_id", "name", "norm_args").agg(F.count("*").alias("n"), F.min(F.struct("idx", "call_pos")).alias("first_pos")).where("n >= 2")
    return with_response_tokens(groups, t.facts(), t.config.default_response).withColumn("wasted", (F.col("n") - 1) * F.col("resp"))


def _scaled(n: str) -> Column:
    """A number of calls times more than any place."""
    return F.col(n).cast("decimal(10,0)") * F.lit(Decimal(1 << 95))


def _per_tool(t: Tables) -> DataFrame:
    """session_id, name, calls, place (of the first), resp and of the groups of equal arguments: spare (calls beyond the first of each), groups (called twice or more), most (n and negative place of the largest, the earliest of them).

    A place is one number, idx before call_pos, and so is a group's n before its place (n below 2 ** 31): numbers are
    aggregated without a sort, structs aren't.
    """
    place = F.col("idx").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("call_pos").cast("decimal(10,0)")
    calls = t.tool_calls().select("session_id", "name", text.canonical_arguments("arguments").alias("norm_args"), place.alias("place"))
    groups = calls.groupBy("session_id", "name", "norm_args").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    tools = groups.groupBy("session_id", "name").agg(
        F.sum("n").alias("calls"), F.min("place").alias("place"), F.sum(F.col("n") - 1).alias("spare"), F.count_if(F.col("n") >= 2).alias("groups"),
        F.max(F.when(F.col("n") >= 2, F.col("n"))).alias("_n"), F.max(F.when(F.col("n") >= 2, _scaled("n") - F.col("place"))).alias("_most"),
    )
    most = F.when(F.col("_n").isNotNull(), F.struct(F.col("_n").alias("n"), (F.col("_most") - _scaled("_n")).alias("p")))
    return with_response_tokens(tools.withColumn("most", most).drop("_n", "_most"), t.facts(), t.config.default_response)


def _per_session(t: Tables) -> DataFrame:
    """session_id and what both findings need, from one pass over the calls."""
    c = t.config
    order = W.partitionBy("session_id").orderBy(F.desc("calls"), "place")
    tools = _per_tool(t).withColumn("r", F.row_number().over(order))
    top = F.when(F.col("most").isNotNull(), F.struct(((F.col("most.n") - 1) * F.col("resp")).alias("w"), F.col("most.p").alias("p"), F.col("name").alias("name"), F.col("most.n").alias("n")))
    high = F.col("calls") >= c.near_calls
    best = high & (F.col("r") <= c.near_names)
    near = F.floor((F.col("calls") - 1) * F.col("resp") * F.lit(c.near_share)).cast("long")
    return tools.groupBy("session_id").agg(
        F.sum(F.col("spare") * F.col("resp")).alias("w"), F.sum("groups").alias("g"), F.max(top).alias("top"),
        F.sum(F.when(best, near)).alias("near_w"), F.sum(F.when(high, F.col("calls"))).alias("near_n"),
        F.sort_array(F.collect_list(F.when(best, F.struct("r", "name", "calls")))).alias("named"),  # near_names at most
    )


def _exact() -> list:
    said = F.format_string("%s was called %d times with the same arguments (%d repeated %s in all)", "top.name", "top.n", "g", plural(F.col("g"), "call", "calls"))
    return finding(0, "duplicate_tool_calls", F.col("w"), F.col("g"), said, 0.95)


def _near() -> list:
    named = F.array_join(F.transform("named", lambda x: F.format_string("%s (%d times)", x["name"], x["calls"])), ", ")
    said = F.concat(F.lit("the same tools were called again and again with other arguments: "), named, F.lit("; about 30% of that is likely redundant"))
    return finding(1, "near_duplicate_tool_calls", F.col("near_w"), F.col("near_n"), said, 0.5)


def exact(t: Tables) -> DataFrame:
    return _per_session(t).where("g > 0").select(*_exact())


def near(t: Tables) -> DataFrame:
    """Only where no calls have equal arguments."""
    return _per_session(t).where("g = 0 and near_w > 0").select(*_near())


def detect(t: Tables) -> DataFrame:
    """A session has one of the two."""
    one = F.when(F.col("g") > 0, F.struct(*_exact())).when(F.col("near_w") > 0, F.struct(*_near()))
    return _per_session(t).select(one.alias("f")).where("f is not null").select("f.*")
