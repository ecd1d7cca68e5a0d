"""Scheduled sessions on an expensive model, and idle checks inside other sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thriftlens.functions import pricing, text
from thriftlens.operators.tables import Tables, finding


def idle_totals(t: Tables) -> DataFrame:
    """session_id, model, input_tokens, scheduled, users, idle, idle_tokens of every session."""
    users = t.facts().where("role = 'user'").groupBy("session_id").agg(
        F.count("*").alias("users"), F.count_if("idle").alias("idle"), F.sum(F.when(F.col("idle"), F.col("tokens")).otherwise(0)).alias("idle_tokens")
    )
    sessions = t.sessions.select("session_id", "model", "input_tokens", text.scheduled("session_id").alias("scheduled"))
    return sessions.join(users, "session_id", "left").na.fill(0, ["users", "idle", "idle_tokens"])


def scheduled(t: Tables) -> DataFrame:
    return _scheduled(idle_totals(t), t)


def _scheduled(totals: DataFrame, t: Tables) -> DataFrame:
    saves = (F.col("cheapest") != F.col("model")) & (F.col("input") - F.col("cheapest_input") > 0)
    found = pricing.priced(totals.where("scheduled"), t.prices).where(saves)
    wasted = pricing.token_equivalent(F.col("input_tokens"), F.col("input"), F.col("cheapest_input"))
    said = F.format_string("the session looks like a scheduled check on %s; switch it to %s (about $%.2f less per 1M input tokens)", "model", "cheapest", F.col("input") - F.col("cheapest_input"))
    return found.select(*finding(0, "heartbeat_waste", wasted, F.col("idle"), said, 0.75))


def idle(t: Tables) -> DataFrame:
    return _idle(idle_totals(t), t)


def _idle(totals: DataFrame, t: Tables) -> DataFrame:
    c = t.config
    found = totals.where(~F.col("scheduled") & (F.col("idle") >= c.idle_messages) & (F.col("users") > 0) & (F.col("idle") >= F.col("users") * F.lit(c.idle_share)))
    said = F.format_string("%d user messages only ask whether anything has happened; batch them or use a cheaper model", "idle")
    return found.select(*finding(1, "heartbeat_waste", F.col("idle_tokens"), F.col("idle"), said, 0.5))


def detect(t: Tables) -> DataFrame:
    totals = idle_totals(t)
    return _scheduled(totals, t).unionByName(_idle(totals, t))
