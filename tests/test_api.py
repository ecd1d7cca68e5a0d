import json
import sqlite3

import pytest

from thriftlens import __version__, api
from thriftlens.__main__ import main


def test_names():
    assert all(hasattr(api, n) for n in api.__all__)


def test_normalize_messages(spark):
    df = spark.createDataFrame([(0, "developer", "a  \r\nb 2026-01-02", "kept"), (1, None, None, "kept")], "idx int, role string, content string, extra string")
    out = api.normalize_messages(df).orderBy("idx").collect()
    assert [(r.role, r.content, r.extra) for r in out] == [("system", "a\nb [DATE]", "kept"), ("user", "", "kept")]


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "cron_a.json"
    path.write_text(json.dumps({"request": {"body": {"model": "o3", "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes"}]}}}))
    assert main(["analyze", str(path)]) == 0
    out = capsys.readouterr().out
    assert out.startswith("Session cron_a: ") and "heartbeat_waste" in out and "> " in out
    assert main(["analyze", str(tmp_path), "--all", "--detectors", "model_mismatch"]) == 0
    assert "heartbeat_waste" not in capsys.readouterr().out
    assert main(["analyze", str(tmp_path / "none.json")]) == 1 and "no session" in capsys.readouterr().err
    assert main([]) == 0
    with pytest.raises(SystemExit):
        main(["--version"])
    assert __version__ in capsys.readouterr().out


def test_analysis_by_session_id(spark, tmp_path, capsys):
    path = tmp_path / "state.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE sessions(id TEXT, model TEXT, message_count INT, tool_call_count INT, input_tokens INT, output_tokens INT, estimated_cost_usd REAL, started_at REAL)")
        db.execute("CREATE TABLE messages(id INTEGER, session_id TEXT, role TEXT, content TEXT, tool_calls TEXT, tool_name TEXT, token_count INT, active INT)")
        db.executemany("INSERT INTO sessions VALUES(?,?,?,?,?,?,?,?)", [("first", "o3", 2, 0, 100, 20, 0.5, 1.0), ("last", "o3", 2, 0, 70, 0, 0, 2.0)])
        db.executemany("INSERT INTO messages VALUES(?,?,?,?,?,?,?,?)", [(i, s, r, c, None, None, None, 1) for s in ("first", "last") for i, (r, c) in enumerate((("user", "hi"), ("assistant", "yes")))])
    db.close()
    assert main(["analyze", "first", "--database", str(path)]) == 0 and "Session first: 120 tokens" in capsys.readouterr().out
    assert main(["analyze", "--database", str(path)]) == 0 and "Session last: 70 tokens" in capsys.readouterr().out
    assert main(["analyze", "nobody", "--database", str(path)]) == 1 and main(["analyze"]) == 1
    (tmp_path / "dumps").mkdir()
    (tmp_path / "dumps" / "d.json").write_text(json.dumps({"request": {"body": {"model": "o3", "messages": []}}}))
    capsys.readouterr()
    assert main(["analyze", "--dumps", str(tmp_path / "dumps")]) == 0 and capsys.readouterr().out.startswith("Session d: ")
    assert main(["analyze", "--all", "--database", str(path)]) == 0 and capsys.readouterr().out.count("Session ") == 2
    assert api.report(spark, "first", database=str(path)).first().report.startswith("Session first: 120 tokens")
    assert api.report(spark, "nobody", database=str(path)) is None
