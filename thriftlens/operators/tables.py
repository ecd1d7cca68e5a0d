"""The tables that detectors read."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.operators import facts
from thriftlens.schema import DEFAULT, Config
from thriftlens.storage import written

FINDING = ["session_id", "emit_ord", "pattern", "tokens_wasted", "count", "description", "confidence"]


def calls_of(messages: DataFrame) -> DataFrame:
    """session_id, idx, call_pos, name, arguments of the assistant's named tool calls."""
    each = messages.where("role = 'assistant'").select("session_id", "idx", F.posexplode("tool_calls").alias("call_pos", "call"))
    rows = each.select("session_id", "idx", "call_pos", F.col("call.function.name").alias("name"), F.col("call.function.arguments").alias("arguments"))
    return rows.where("name is not null and name <> ''")


@dataclass
class Tables:
    """sessions and messages; tool calls are taken from the messages unless given as a table of their own.

    Detectors read facts() and lines(), not texts. prepared() makes a table of both in one pass, for several detectors.
    With strict, a detector that fails, on one session or at all, ends the analysis, as the findings wouldn't be whole
    without its own; otherwise it's reported and left out.
    """

    sessions: DataFrame | None
    messages: DataFrame
    calls: DataFrame | None = None
    prices: DataFrame | None = None
    config: Config = field(default=DEFAULT)
    table: DataFrame | None = None  # of facts, with lines if has_lines
    has_lines: bool = False
    sets: DataFrame | None = None  # f1, f2, lines: of tables in which many messages have the same lines, and then not in table
    strict: bool = False

    def facts(self) -> DataFrame:
        """A row of numbers for each message: see operators/facts.py."""
        if self.table is None:
            return facts.facts_of(self.messages)
        return self.table.drop("f1", "f2", "size", "lines")

    def lines(self) -> DataFrame:
        """session_id, idx, f1, f2, size of each long tool response that has lines to share, and the lines if sets is None."""
        held = self.table if self.has_lines else facts.lines_of(self.messages, self.config)
        return held.where("f1 is not null").select("session_id", "idx", "f1", "f2", "size", *([] if self.sets is not None else ["lines"]))

    def prepared(self, lines: bool = True) -> Tables:
        """The same with its facts as a table, so that the texts are read once."""
        if self.table is not None and (self.has_lines or not lines):
            return self
        calls = self.calls is None
        table = facts.facts_and_lines(self.messages, self.config, calls) if lines else written(facts.facts_of(self.messages, calls), "facts")
        return replace(self, table=table, has_lines=lines)

    def tool_calls(self) -> DataFrame:
        return self.calls if self.calls is not None else calls_of(self.facts())


def finding(order: int, pattern: str, tokens: Column, count: Column, description: Column, confidence: float) -> list[Column]:
    """The columns of a finding, from a DataFrame with one row per session."""
    return [
        F.col("session_id"), F.lit(order).alias("emit_ord"), F.lit(pattern).alias("pattern"), tokens.cast("long").alias("tokens_wasted"), count.cast("long").alias("count"),
        description.alias("description"), F.lit(confidence).cast("double").alias("confidence"),
    ]


def plural(n: Column, one: str, more: str) -> Column:
    return F.when(n == 1, one).otherwise(more)


def response_tokens(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Average tokens of tool responses: by (session_id, name), and by session_id."""
    tool = facts.where("role = 'tool'").select("session_id", F.col("tool_name").alias("name"), F.col("tokens").alias("t"))
    average = F.floor(F.sum("t") / F.count("*")).cast("long")
    return tool.where("name is not null").groupBy("session_id", "name").agg(average.alias("by_name")), tool.groupBy("session_id").agg(average.alias("by_session"))


def with_response_tokens(df: DataFrame, facts: DataFrame, default: int) -> DataFrame:
    """df (session_id, name, ...) with `resp`: of the tool, else of all tools of the session, else a default."""
    by_name, by_session = response_tokens(facts)
    both = df.join(by_name, ["session_id", "name"], "left").join(by_session, "session_id", "left")
    return both.withColumn("resp", F.coalesce("by_name", "by_session", F.lit(default))).drop("by_name", "by_session")
