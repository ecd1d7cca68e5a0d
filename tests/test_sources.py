import json
import os
import sqlite3

import pytest

from thriftlens.operators.tables import Tables
from thriftlens.plans import analysis
from thriftlens.sources.database import read_database
from thriftlens.sources.dumps import read_dumps
from thriftlens.sources.resolve import read_all, read_session


@pytest.fixture
def database(tmp_path):
    path = tmp_path / "state.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE sessions(id TEXT, model TEXT, message_count INT, tool_call_count INT, input_tokens INT, output_tokens INT, estimated_cost_usd REAL, started_at REAL)")
        db.execute("CREATE TABLE messages(id INTEGER, session_id TEXT, role TEXT, content TEXT, tool_calls TEXT, tool_name TEXT, token_count INT, active INT)")
        db.executemany("INSERT INTO sessions VALUES(?,?,?,?,?,?,?,?)", [("old", "o3", 3, 1, 100, 20, 0.5, 1.0), ("new", None, None, None, None, None, None, 2.0)])
        calls = json.dumps([{"id": "c", "type": "function", "function": {"name": "bash", "arguments": '{"a": 1}'}}])
        rows = [(5, "old", "assistant", None, calls, None, None, 1), (2, "old", "user", "hi", "", "", 0, 1), (9, "old", "tool", "out", None, "bash", 7, 1), (7, "old", "user", "gone", None, None, None, 0), (1, "new", "assistant", "x", "not json", None, None, 1)]
        db.executemany("INSERT INTO messages VALUES(?,?,?,?,?,?,?,?)", rows)
    return str(path)


def test_database(spark, database):
    sessions, messages = read_database(spark, database)
    s = {r["session_id"]: r for r in sessions.collect()}
    assert s["old"].input_tokens == 100 and s["old"].cost_usd == 0.5 and s["new"].model is None and s["new"].message_count == 0 and s["old"].source == "sqlite"
    m = [(r.session_id, r.idx, r.role, r.content, r.tool_name, r.token_count, r.tool_calls_raw) for r in messages.orderBy("session_id", "idx").collect()]
    assert m == [("new", 0, "assistant", "x", None, None, "not json"), ("old", 0, "user", "hi", None, None, None), ("old", 1, "assistant", "", None, None, None), ("old", 2, "tool", "out", "bash", 7, None)]
    call = messages.where("role = 'assistant' and session_id = 'old'").first()["tool_calls"][0]
    assert call.function.name == "bash" and call.function.arguments == '{"a": 1}'


def test_one_session_of_a_database(spark, database):
    sessions, messages = read_database(spark, database, session_id="old")
    assert sessions.count() == 1 and messages.count() == 3
    sessions, messages = read_database(spark, database, latest=True)
    assert sessions.first()["session_id"] == "new" and messages.count() == 1


def dump(path, body, **more):
    path.write_text(json.dumps({"session_id": "ignored", "request": {"body": body}} | more))
    return path


BODY = {"model": "claude-opus-4-8", "messages": [{"role": "user", "content": "hé"}, {"role": "assistant", "content": None, "tool_calls": [{"id": "1", "type": "function", "function": {"name": "f", "arguments": "{}"}}]}, {"role": "tool", "content": "ok", "tool_call_id": "1"}]}


def test_dump(spark, tmp_path):
    sessions, messages = read_dumps(spark, dump(tmp_path / "request_dump_20260710_214623_e95335_x_y.json", BODY))
    s = sessions.first()
    assert (s.session_id, s.model, s.message_count, s.tool_call_count, s.source) == ("20260710_214623_e95335", "claude-opus-4-8", 3, 1, "json")
    assert s.input_tokens == sum(len(json.dumps(m)) for m in BODY["messages"]) // 4
    assert [(r.idx, r.role, r.content, r.tool_call_id) for r in messages.orderBy("idx").collect()] == [(0, "user", "hé", None), (1, "assistant", None, None), (2, "tool", "ok", "1")]


def test_dump_with_a_body_of_text(spark, tmp_path):
    sessions, messages = read_dumps(spark, dump(tmp_path / "a.json", json.dumps(BODY)))
    assert sessions.first()["model"] == "claude-opus-4-8" and messages.count() == 3


def test_odd_dumps(spark, tmp_path):
    dump(tmp_path / "empty.json", {"messages": []})
    dump(tmp_path / "broken.json", "{not json")
    (tmp_path / "text.json").write_text("no json")
    (tmp_path / "list.json").write_text("[1, 2]")
    dump(tmp_path / "sessions.json", BODY)
    sessions, messages = read_dumps(spark, tmp_path)
    got = {r.session_id: (r.model, r.message_count, r.input_tokens) for r in sessions.collect()}
    assert got == {"empty": ("unknown", 0, 1), "broken": ("unknown", 0, 1)} and messages.count() == 0


def test_resolution(spark, tmp_path, database):
    folder = tmp_path / "dumps"
    folder.mkdir()
    old, new = dump(folder / "old.json", BODY), dump(folder / "new.json", BODY)
    os.utime(old, (1, 1))
    name = lambda found: found[0].first()["session_id"]
    assert name(read_session(spark, str(folder))) == "new" and name(read_session(spark, str(old))) == "old" and new.exists()
    assert name(read_session(spark, database)) == "new" and name(read_session(spark, "old", database=database)) == "old"
    assert name(read_session(spark, database=database)) == "new" and name(read_session(spark, dumps=str(folder))) == "new"
    assert read_session(spark, str(tmp_path / "none.json")) is None and read_session(spark, "nobody", database=database) is None and read_session(spark) is None
    assert read_all(spark, database)[0].count() == 2 and read_all(spark, str(folder))[0].count() == 2


def test_sources_feed_the_analysis(spark, tmp_path):
    t = Tables(*read_dumps(spark, dump(tmp_path / "cron_a.json", BODY)))
    assert {r["pattern"] for r in analysis.run_analysis(t).collect()} == {"heartbeat_waste", "model_mismatch"}


def test_ranges_of_one_database_and_a_folder_of_them(spark, tmp_path):
    """Two numbers cut a database into parts; each database of a folder is a part; sessions of both are the same."""
    import sqlite3

    from thriftlens.sources.database import SessionReader

    folder = tmp_path / "many"
    folder.mkdir()
    one = tmp_path / "one.db"
    for path, ids in ((one, range(1300)), (folder / "a.db", range(0, 1300, 2)), (folder / "b.db", range(1, 1300, 2))):
        with sqlite3.connect(path) as db:
            db.execute("CREATE TABLE sessions(id TEXT, model TEXT, started_at)")
            db.execute("CREATE TABLE messages(id INTEGER, session_id TEXT, role TEXT, content TEXT, tool_calls TEXT, tool_name TEXT, token_count INT, active INT)")
            db.executemany("INSERT INTO sessions VALUES(?, 'm', ?)", [(f"s{i}", None if i == 3 else f"2026-{i}" if i == 7 else i) for i in ids])
            db.executemany("INSERT INTO messages VALUES(?, ?, 'user', ?, NULL, NULL, NULL, 1)", [(i, f"s{i % 50}", f"text {i}") for i in ids])
    parts = SessionReader(str(one), "messages", 8).partitions()
    assert len(parts) == 8 and [(p.low, p.high) for p in parts][0][0] == 1 and parts[-1].high == 1301
    assert len(SessionReader(str(folder), "messages", 8).partitions()) == 2
    rows = [[sorted(map(tuple, df.collect()), key=repr) for df in read_database(spark, str(p))] for p in (one, folder)]
    assert rows[0] == rows[1] and len(rows[0][0]) == len(rows[0][1]) == 1300
    for path in (one, folder):  # a text comes after all numbers
        assert [r.session_id for r in read_database(spark, str(path), latest=True)[0].collect()] == ["s7"]
