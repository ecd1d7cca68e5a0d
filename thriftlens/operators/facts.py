"""What detectors need to know of a message: a row of numbers for each, from one pass over the texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftlens.functions import text
from thriftlens.schema import CALLS, Config
from thriftlens.storage import importable, written

#: session_id, idx, role, tool_name, chars and tokens of the text, idle (of a user's message), tools (names that a system
#: message defines), n_calls.
FACTS = "session_id string, idx long, role string, tool_name string, chars int, tokens long, idle boolean, tools array<string>, n_calls int"
#: Of a long tool response: a 128-bit fingerprint of its set of lines, their length, and each line's hash and length.
LINES = "f1 long, f2 long, size long, lines array<struct<h1:bigint,h2:bigint,n:bigint>>"


def _columns(messages: DataFrame, calls: bool) -> list[Column]:
    tool_calls = F.col("tool_calls") if "tool_calls" in messages.columns else F.lit(None).cast(CALLS)
    return [
        F.col("session_id"), F.col("idx").cast("long").alias("idx"), F.col("role"), F.col("tool_name"), F.length(text.text("content")).alias("chars"), text.tokens("content").cast("long").alias("tokens"),
        F.when(F.col("role") == "user", text.idle("content")).alias("idle"), F.when(F.col("role") == "system", text.tool_names("content")).alias("tools"),
        F.coalesce(F.size(tool_calls), F.lit(0)).alias("n_calls"), *([tool_calls.alias("tool_calls")] if calls else []),
    ]


def facts_of(messages: DataFrame, calls: bool = True) -> DataFrame:
    """The facts of messages, all in the JVM; `calls` keeps their tool calls."""
    return messages.select(*_columns(messages, calls))


def _long(config: Config):
    return F.when((F.col("role") == "tool") & (F.length(text.text("content")) > config.stale_overlap), F.col("content")).alias("_long")


def _hashed(rows: DataFrame, least: int) -> DataFrame:
    """rows with LINES in place of the text _long (last column): null where that is null or has no line longer than least.

    Splitting and trimming at all of Unicode's line ends and blanks is four times as fast in Python, by batches, as by
    regular expressions.
    """
    kind = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, prints, totals, upto = [], [], [], [], [0]
            for content in b.column(b.num_columns - 1).to_pylist():
                found = sorted((hashlib.blake2b(x.encode(), digest_size=16).digest(), len(x)) for x in {x for x in map(str.strip, content.splitlines()) if len(x) > least}) if content else []
                digests += [h for h, _ in found]
                sizes += [n for _, n in found]
                upto.append(len(digests))
                prints.append(hashlib.blake2b(b"".join(h for h, _ in found), digest_size=16).digest() if found else None)
                totals.append(sum(n for _, n in found) if found else None)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            items = pa.StructArray.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(sizes, pa.int64())], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), items, mask=pa.array([p is None for p in prints], pa.bool_()))
            own = np.frombuffer(b"".join(p or bytes(16) for p in prints), np.int64).reshape(-1, 2)
            none = np.array([p is None for p in prints], bool)
            both = [pa.array(own[:, k].copy(), mask=none) for k in (0, 1)]
            names = [*b.schema.names[:-1], "f1", "f2", "size", "lines"]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *both, pa.array(totals, pa.int64()), lists], names)

    importable(rows.sparkSession)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, {LINES}")


def facts_and_lines(messages: DataFrame, config: Config, calls: bool = True) -> DataFrame:
    """Facts with LINES, as a table: texts are read once, and what is read after that is numbers."""
    return written(_hashed(messages.select(*_columns(messages, calls), _long(config)), config.line_length), "facts")


def with_lines(facts: DataFrame) -> DataFrame:
    """facts with the f1, f2 and size of messages that have no lines."""
    return facts.select("*", *[F.lit(None).cast("long").alias(name) for name in ("f1", "f2", "size")])


def facts_of_literals(texts: list[str], at: Column) -> Column:
    """A struct of chars, tokens and idle of the user's message that is the at-th (from 1) of a few fixed texts.

    All of it is constants, which Spark folds when it plans, so no row's text is measured or matched.
    """
    each = [F.struct(F.length(text.text(c)).alias("chars"), text.tokens(c).alias("tokens"), text.idle(c).alias("idle")) for c in map(F.lit, texts)]
    return F.element_at(F.array(*each), at)


def shared_sets(table: DataFrame) -> DataFrame:
    """f1, f2, lines of the sets of lines of facts_and_lines(): only lines that more than one set holds, and only sets that have such.

    A line of one set alone is shared by no two of them, so pairs and what they share stay the same; the f1, f2 and size
    of messages are still those of all lines. Sets are counted once, however many messages have them.
    """
    sets = table.where("lines is not null").groupBy("f1", "f2").agg(F.first("lines").alias("lines"))
    each = written(sets.select("f1", "f2", F.inline("lines")), "set-lines")
    common = written(each.groupBy("h1", "h2").agg(F.count("*").alias("sets")).where("sets > 1").select("h1", "h2"), "common")
    return written(each.join(common, ["h1", "h2"]).groupBy("f1", "f2").agg(F.collect_list(F.struct("h1", "h2", "n")).alias("lines")), "sets")


def sharable(table: DataFrame) -> DataFrame:
    """facts_and_lines() with only the lines of shared_sets(); a message keeps an empty list if none is left."""
    left = shared_sets(table).withColumnRenamed("lines", "_some")
    none = F.array().cast(table.schema["lines"].dataType)
    rows = table.join(left.hint("merge"), ["f1", "f2"], "left")
    return rows.withColumn("lines", F.when(F.col("lines").isNotNull(), F.coalesce("_some", none))).select(*table.columns)


def lines_of(messages: DataFrame, config: Config) -> DataFrame:
    """session_id, idx and LINES of long tool responses, as a table."""
    rows = messages.select("session_id", F.col("idx").cast("long").alias("idx"), _long(config)).where("_long is not null")
    return written(_hashed(rows, config.line_length), "lines")
