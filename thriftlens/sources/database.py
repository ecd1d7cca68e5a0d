"""Session databases (SQLite) as a Spark data source, in a Python reader: there is no JDBC driver to rely on.

    register(spark)
    spark.read.format("session_db").option("path", p).option("table", "sessions").load()

The path is a database, or a folder of them (*.db), each read by a task of its own. A single database is cut into ranges
of rowids, from the least and the greatest: two numbers on the driver, whatever its size. Rows come as Arrow batches of
a bounded number of rows. Filters id = ... are pushed into the query. Inactive messages are left out, the idx is the
order of ids. Files must be readable where the tasks run (a shared folder on a cluster).
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from thriftlens.schema import CALLS
from thriftlens.storage import importable

#: began_*: what started_at is sorted by, as SQLite does: none, numbers, then texts.
_SESSIONS = "session_id string, model string, message_count long, tool_call_count long, input_tokens long, output_tokens long, cost_usd double, started_at string, began_kind int, began_number double, began_text string, place long"
_MESSAGES = "session_id string, id long, role string, content string, tool_calls string, tool_name string, token_count long"
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
#: Rows of an Arrow batch.
ROWS = 500


def _open(path: str) -> sqlite3.Connection:
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    db.row_factory = sqlite3.Row
    return db


def files_of(path: str) -> list[str]:
    if not os.path.isdir(path):
        return [path]
    return sorted(f"{path}/{f}" for f in os.listdir(path) if f.endswith(".db"))


class _Part(InputPartition):
    def __init__(self, path: str, low: int | None = None, high: int | None = None):
        self.path, self.low, self.high = path, low, high


class SessionReader(DataSourceReader):
    def __init__(self, path: str, kind: str, parts: int):
        self.path, self.kind, self.parts, self.wanted = path.removeprefix("file://").removeprefix("file:"), kind, parts, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("session_id",) and self.wanted is None:
                self.wanted = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """A part for each file; of a single one, ranges of rowids."""
        files = files_of(self.path)
        if len(files) != 1 or self.wanted is not None:
            return [_Part(f) for f in files]
        try:
            with _open(files[0]) as db:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.kind}").fetchone()
        except sqlite3.OperationalError:  # a table without rowids
            return [_Part(files[0])]
        if low is None:
            return [_Part(files[0])]
        n = max(1, min(self.parts, high - low + 1))
        cuts = [low + (high - low + 1) * i // n for i in range(n)] + [high + 1]
        return [_Part(files[0], a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        names, types = zip(*(c.split() for c in (_SESSIONS if self.kind == "sessions" else _MESSAGES).split(", ")))
        schema = pa.schema([(n, _ARROW[t]) for n, t in zip(names, types)])
        where, args = ["active = 1"] if self.kind == "messages" else [], []
        for condition, value in ((f"{'id' if self.kind == 'sessions' else 'session_id'} = ?", self.wanted), ("rowid >= ?", partition.low), ("rowid < ?", partition.high)):
            if value is not None:
                where.append(condition)
                args.append(value)
        chosen = "*" if self.kind == "sessions" else "session_id, id, role, content, tool_calls, tool_name, token_count"
        db = _open(partition.path)
        try:
            found = db.execute(f"SELECT {chosen} FROM {self.kind}{' WHERE ' + ' AND '.join(where) if where else ''}", args)
            place = partition.low or 0
            while rows := found.fetchmany(ROWS):
                made = [_session(dict(r), place + i) for i, r in enumerate(rows)] if self.kind == "sessions" else [tuple(x if x is None else str(x) if pa.types.is_string(t) else int(x) for x, t in zip(r, schema.types)) for r in rows]
                place += len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), schema.types)], schema=schema)
        finally:
            db.close()


def _session(d: dict, place: int) -> tuple:
    number = lambda k, kind: kind(d.get(k) or 0)
    began = d.get("started_at")
    kind = 0 if began is None else 1 if isinstance(began, (int, float)) else 2
    return (
        str(d.get("id", "")), d.get("model", "unknown"), number("message_count", int), number("tool_call_count", int), number("input_tokens", int),
        number("output_tokens", int), number("estimated_cost_usd", float), str(d.get("started_at", "")),
        kind, float(began) if kind == 1 else None, str(began) if kind == 2 else None, place,
    )


class SessionDatabase(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_db"

    def schema(self) -> str:
        return _SESSIONS if self.options.get("table", "sessions") == "sessions" else _MESSAGES

    def reader(self, schema) -> SessionReader:
        return SessionReader(self.options["path"], self.options.get("table", "sessions"), int(self.options.get("parts", "8")))


def register(spark: SparkSession) -> None:
    importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SessionDatabase)


def typed_messages(rows: DataFrame) -> DataFrame:
    """Messages as detectors read them: empty text for none, calls parsed, what isn't JSON kept as it is."""
    raw = F.when(F.length("tool_calls") > 0, F.col("tool_calls"))
    good = F.try_parse_json(raw).isNotNull()
    order = W.partitionBy("session_id").orderBy("id")
    return rows.select(
        "session_id", (F.row_number().over(order) - 1).cast("long").alias("idx"), "role", F.coalesce("content", F.lit("")).alias("content"),
        F.when(F.length("tool_name") > 0, F.col("tool_name")).alias("tool_name"), F.lit(None).cast("string").alias("tool_call_id"),
        F.when(F.col("token_count") != 0, F.col("token_count")).alias("token_count"),
        F.when(good, F.from_json(raw, CALLS)).alias("tool_calls"), F.when(~good, raw).alias("tool_calls_raw"),
    )


def read_database(spark: SparkSession, path: str, session_id: str | None = None, latest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sessions, messages) of a database, or of a folder of them: all of it, one session, or the session that began last."""
    register(spark)
    load = lambda kind: spark.read.format("session_db").option("path", str(path)).option("table", kind).load()
    sessions, messages = load("sessions"), load("messages")
    if session_id is not None:
        sessions, messages = sessions.where(F.col("session_id") == session_id), messages.where(F.col("session_id") == session_id)
    elif latest:
        sessions = sessions.orderBy(F.desc("began_kind"), F.desc("began_number"), F.desc("began_text"), "place").limit(1)
        messages = messages.join(sessions.select("session_id"), "session_id", "left_semi")
    return sessions.drop("began_kind", "began_number", "began_text", "place").withColumn("source", F.lit("sqlite")), typed_messages(messages)
