"""Simple questions that were put to an expensive model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thriftlens.functions import pricing
from thriftlens.operators.tables import Tables, finding, plural


def expensive_sessions(t: Tables) -> DataFrame:
    """session_id, model, input, cheapest, cheapest_input of sessions on a model with a cheaper equivalent.

    Prices are an expression on the session's row, so sessions are sorted out before any message is read.
    """
    known = pricing.priced(t.sessions.where("model <> 'unknown'").select("session_id", "model"), t.prices)
    saves = (F.col("input") > t.config.expensive) & (F.col("input") - F.col("cheapest_input") > 0)
    return known.where(saves).select("session_id", "model", "input", "cheapest", "cheapest_input")


def answered(facts: DataFrame, config) -> DataFrame:
    """session_id, idx, tokens (of question and answer), simple: each user message with the assistant's answer, within two messages.

    What is sorted by session are lengths, never texts: of a question its tokens and whether it is short, in one number,
    and of an answer its tokens, whether it has no calls and whether it is short, in another.
    """
    order = W.partitionBy("session_id").orderBy("idx")
    bit = lambda c: F.when(c, 1).otherwise(0)
    question = F.col("tokens") * 2 + bit(F.col("chars") < config.short_prompt)
    answer = F.col("tokens") * 4 + bit(F.col("n_calls") <= 0) * 2 + bit(F.col("chars") < config.short_answer)
    rows = facts.select("session_id", "idx", F.when(F.col("role") == "user", question).alias("q"), F.when(F.col("role") == "assistant", answer).alias("a"))
    ahead = rows.select("session_id", "idx", "q", F.coalesce(F.lead("a", 1).over(order), F.lead("a", 2).over(order)).alias("a"))
    simple = F.expr("a & 1 = 1 and (q & 1 = 1 or a & 2 = 2)")
    return ahead.where("q is not null and a is not null").select("session_id", "idx", F.expr("(q >> 1) + (a >> 2)").alias("tokens"), simple.alias("simple"))


def simple_queries(t: Tables) -> DataFrame:
    """session_id, n, tokens of simple queries in sessions on an expensive model."""
    sessions = expensive_sessions(t)
    facts = t.facts().join(sessions.select("session_id"), "session_id", "left_semi")
    simple = answered(facts, t.config).where("simple")
    per = simple.groupBy("session_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    return per.join(sessions, "session_id")


def detect(t: Tables) -> DataFrame:
    wasted = pricing.token_equivalent(F.col("tokens"), F.col("input"), F.col("cheapest_input"))
    said = F.format_string(
        "%d simple %s went to %s ($%.2f per 1M input tokens); switch to %s ($%.2f) for the like", "n", plural(F.col("n"), "query", "queries"), "model", "input", "cheapest", "cheapest_input"
    )
    return simple_queries(t).select(*finding(0, "model_mismatch", wasted, F.col("n"), said, 0.7))
