from collections import Counter

import pytest
from pyspark.sql import functions as F

from thriftlens.operators import bloat, duplicates, registry
from thriftlens.operators.tables import Tables
from thriftlens.plans import analysis
from thriftlens.schema import CALLS, MESSAGES, SESSIONS


def session(spark, sid, model, messages, input_tokens=0, output_tokens=0, cost=0.0, count=None):
    """messages: (role, content, tool_name, [(name, arguments)])."""
    rows = []
    for i, m in enumerate(messages):
        role, content, tool, calls = (*m, *[None] * (4 - len(m)))
        rows.append((sid, i, role, content, tool, None, None, [("", "function", (n, a)) for n, a in calls] if calls else None, None))
    s = spark.createDataFrame([(sid, model, len(rows) if count is None else count, 0, input_tokens, output_tokens, cost, "", "json")], SESSIONS)
    return Tables(s, spark.createDataFrame(rows, MESSAGES))


def found(t, detectors=None):
    rows = analysis.run_analysis(t, detectors).orderBy("rank").collect()
    return [(r["pattern"], r["tokens_wasted"], r["count"], r["confidence"]) for r in rows]


def both(a, b):
    return Tables(a.sessions.unionByName(b.sessions), a.messages.unionByName(b.messages))


CALL = [("read_file", '{"path": "a.py"}')]


def test_equal_calls(spark):
    m = [("user", "read it"), ("assistant", None, None, CALL), ("tool", "contents...", "read_file"), ("assistant", "", None, [("read_file", '{"path":"a.py"}')]), ("tool", "contents...", "read_file")]
    assert found(session(spark, "s", "claude-haiku-4.5", m)) == [("duplicate_tool_calls", 2, 1, 0.95)]


def test_other_arguments_are_no_duplicates(spark):
    m = [("assistant", "", None, CALL), ("assistant", "", None, [("read_file", '{"path": "b.py"}')])]
    assert found(session(spark, "s", "claude-haiku-4.5", m)) == []


def test_near_duplicates(spark):
    m = [("assistant", "", None, [("bash", f"ls {i}")]) for i in range(4)] + [("tool", "x" * 400, "other")]
    assert found(session(spark, "s", "x", m)) == [("near_duplicate_tool_calls", int(3 * 100 * 0.3), 4, 0.5)]
    assert found(session(spark, "s", "x", [("assistant", "", None, [("bash", "ls"), ("bash", "ls"), ("bash", "x")])])) == [("duplicate_tool_calls", 100, 1, 0.95)]


def test_long_session(spark):
    m = [("user", "question"), ("assistant", "a long answer " * 40)] * 60
    assert found(session(spark, "s", "claude-haiku-4.5", m, input_tokens=50_000)) == [("context_bloat", 12_500, 120, 0.4)]
    assert found(session(spark, "s", "claude-haiku-4.5", m[:2], input_tokens=30)) == []


def test_overhead_needs_messages_and_no_better_reason(spark):
    assert found(session(spark, "s", "x", [], input_tokens=50_000, count=40)) == []
    big = [("tool", f"{i} " * 15_000, "t") for i in range(31)]
    assert [f[3] for f in found(session(spark, "s", "x", big, input_tokens=1000))] == [0.55]


def test_stale(spark):
    a, b = "a line that is longer than twenty characters " * 5, "another line that is longer than twenty characters " * 5
    m = [("tool", f"{a}\n{b}", "t"), ("tool", f"{b}\n{a}\nx", "t"), ("tool", f"{b}\nunlike", "t")]
    pair = len(a.strip()) + len(b.strip())
    want = pair // 4 + 2 * (len(b.strip()) // 4)
    assert found(session(spark, "s", "x", m)) == [("context_bloat", want, 3, 0.65)]
    assert found(session(spark, "s", "x", m[:2])) == []


def test_oversized_names_the_first(spark):
    t = session(spark, "s", "x", [("tool", "x" * 5005, "one"), ("tool", "y" * 9000, "two"), ("tool", "z" * 5000, "no")])
    assert found(t) == [("context_bloat", 1 + 1000, 2, 0.55)]
    assert "from one, by 5" in analysis.run_analysis(t).first()["description"]


def test_unused_tools(spark):
    system = "\n".join(f'{{"name": "t{i}"}}' for i in range(5))
    t = session(spark, "s", "x", [("system", system), ("system", '{"name": "later"}'), ("assistant", "", None, [("t3", "")])])
    assert found(t) == [("context_bloat", 2000, 4, 0.7)]
    assert "(t0, t1, t2 and others)" in analysis.run_analysis(t).first()["description"]
    assert found(session(spark, "s", "x", [("system", system.replace("t4", "t3"))])) == []


def test_simple_queries(spark):
    m = [("user", "What is 2+2?"), ("assistant", "4"), ("user", "Capital of France?"), ("assistant", "Paris")]
    assert found(session(spark, "s", "claude-opus-4-8", m)) == [("model_mismatch", int((3 + 1 + 4 + 1) * 14.2 / 15), 2, 0.7)]
    for model in ("claude-haiku-4.5", "unknown", "no-such-model", None):
        assert found(session(spark, "s", model, m)) == []


def test_answer_within_two_messages(spark):
    m = [("user", "one"), ("user", "two"), ("assistant", "yes"), ("user", "x" * 600), ("tool", "t"), ("tool", "t"), ("assistant", "no")]
    assert found(session(spark, "s", "o3", m)) == [("model_mismatch", int(4 * (9.95 / 10)), 2, 0.7)]
    assert found(session(spark, "s", "o3", [("user", "x" * 600), ("assistant", "ok", None, CALL)])) == []


def test_scheduled(spark):
    m = [("user", "status?"), ("assistant", "fine " * 80)]
    assert found(session(spark, "cron_daily_check_001", "claude-opus-4-8", m, input_tokens=30)) == [("heartbeat_waste", 28, 0, 0.75)]
    assert found(session(spark, "cron", "claude-opus-4-8", [], input_tokens=30)) == [("heartbeat_waste", 28, 0, 0.75)]
    assert found(session(spark, "cron", "claude-haiku-4.5", m, input_tokens=30)) == []
    assert found(session(spark, "chat_1", "claude-opus-4-8", m, input_tokens=30)) == []


def test_idle(spark):
    long = "answer " * 100
    m = [("user", "still running?"), ("assistant", long), ("user", "any updates?"), ("assistant", long), ("user", "write the code"), ("assistant", long)]
    assert found(session(spark, "s", "x", m)) == [("heartbeat_waste", 3 + 3, 2, 0.5)]
    assert found(session(spark, "s", "x", m + [("user", "more"), ("user", "and more")] * 2)) == []


def test_sessions_do_not_mix(spark):
    one = session(spark, "a", "x", [("assistant", "", None, CALL)])
    two = session(spark, "b", "x", [("assistant", "", None, CALL)])
    assert found(both(one, two)) == []


def test_choice_of_detectors(spark, caplog):
    t = session(spark, "cron", "o3", [("user", "hi"), ("assistant", "yes")], input_tokens=100)
    assert [f[0] for f in found(t, ["model_mismatch", "nope"])] == ["model_mismatch"]
    assert "nope" in caplog.text
    assert found(t, ["nope"]) == []
    assert registry.list_detectors() == ["context_bloat", "duplicate_tool_calls", "heartbeat_waste", "model_mismatch"]


def test_own_detectors(spark):
    def mine(s, messages):
        return [{"pattern": "mine", "tokens_wasted": len(messages), "count": 1, "description": s["model"]}]

    def broken(t):
        raise RuntimeError("no plan")

    registry.register_detector("mine", registry.per_session(mine))
    registry.register_detector("broken", broken)
    try:
        assert registry.get_detector("mine") and not registry.get_detector("none")
        assert found(session(spark, "s", "m", [("user", "a"), ("user", "b")]), ["broken", "mine"]) == [("mine", 2, 1, 0.8)]
    finally:
        del registry._registry["mine"], registry._registry["broken"]


def test_a_detector_that_fails_while_it_runs(spark):
    """Its findings are missing, for the sessions it failed on or at all; everything else is there."""

    def picky(s, messages):
        if s["model"] == "bad":
            raise ValueError("no")
        return [{"pattern": "picky", "tokens_wasted": "x" if s["model"] == "odd" else 1, "count": 1, "description": ""}]

    @F.udf("long")
    def never(x):
        raise ValueError("no")

    def udf(t):
        row = t.sessions.select("session_id", F.lit(0).alias("emit_ord"), F.lit("udf").alias("pattern"), never("session_id").alias("tokens_wasted"))
        return row.select("*", F.lit(1).cast("long").alias("count"), F.lit("").alias("description"), F.lit(0.5).alias("confidence"))

    registry.register_detector("picky", registry.per_session(picky))
    registry.register_detector("udf", udf)
    try:
        each = [session(spark, f"cron_{m}", m, [("user", "a")]) for m in ("bad", "odd", "o3")]
        t = Tables(each[0].sessions.unionByName(each[1].sessions).unionByName(each[2].sessions), each[0].messages.unionByName(each[1].messages).unionByName(each[2].messages))
        out = analysis.run_analysis(t).collect()
        assert {(r.session_id, r.pattern) for r in out if r.pattern in ("picky", "udf")} == {("cron_o3", "picky")}
        assert analysis.analyze(t).count() == 3
    finally:
        del registry._registry["picky"], registry._registry["udf"]


def test_a_hot_session_and_a_hot_line(spark):
    """Thousands of calls with few arguments, and one line in all responses of a session."""
    n = 3000
    messages = [("assistant", "", [("f", f'{{"a": {i % 700}}}')]) if i % 2 else ("tool", "x" * 11) for i in range(2 * n)]
    rows = [("s", i, m[0], m[1], "f" if m[0] == "tool" else None, [{"id": "", "type": "function", "function": {"name": c[0], "arguments": c[1]}} for c in m[2]] if len(m) > 2 else None) for i, m in enumerate(messages)]
    m = spark.createDataFrame(rows, f"session_id string, idx long, role string, content string, tool_name string, tool_calls {CALLS}")
    s = spark.createDataFrame([("s", "o3", 2 * n, n, 10, 0, 0.0)], "session_id string, model string, message_count long, tool_call_count long, input_tokens long, output_tokens long, cost_usd double")
    r = duplicates.detect(Tables(s, m)).collect()
    counts = Counter((i % 700) for i in range(1, 2 * n, 2))
    assert [(x["count"], x["tokens_wasted"]) for x in r] == [(sum(v >= 2 for v in counts.values()), sum(v - 1 for v in counts.values()) * (11 // 4))]
    line = "the same line of more than twenty characters " * 5
    rows = [("s", i, "tool", f"{line}\nown line number {i} of this response only", None, None) for i in range(40)]
    m = spark.createDataFrame(rows, f"session_id string, idx long, role string, content string, tool_name string, tool_calls {CALLS}")
    pairs = bloat.overlap_pairs(Tables(s, m)).collect()
    assert len(pairs) == 40 * 39 // 2 and {p["overlap"] for p in pairs} == {len(line.strip())}


FINDINGS = "session_id string, pattern string, tokens_wasted long, count long, description string, confidence double, rank int"


def test_report(spark):
    t = session(spark, "s", "x", [], input_tokens=10_000, output_tokens=2_000, cost=0.05)
    f = spark.createDataFrame([("s", "context_bloat", 3000, 2, "two\nlines", 0.6, 1)], FINDINGS)
    text = analysis.format_output(t.sessions, f).first()["report"]
    assert text == "Session s: 12,000 tokens, ~$0.05, 25% avoidable.\n\nTop wastes:\n  1. context_bloat (2x): ~3,000 tokens — two\n      lines"
    none = analysis.format_output(t.sessions, f.limit(0)).first()["report"]
    assert none == "Session s: 12,000 tokens, ~$0.05. No significant waste detected."
    million = session(spark, "m", "x", [], input_tokens=1_000_000)
    assert "~$1.00" in analysis.format_output(million.sessions, f).first()["report"]
    nothing = session(spark, "s", "x", [])
    assert analysis.format_output(nothing.sessions, f).first()["report"].startswith("Session s: 0 tokens, unknown, ~3,000 tokens waste.")


def test_advice(spark):
    rows = [("s", p, 10, 4, d, 0.5, i + 1) for i, (p, d) in enumerate([("near_duplicate_tool_calls", "x"), ("duplicate_tool_calls", "bash was called"), ("model_mismatch", "switch to gpt-5-nano"), ("odd", "what?"), ("context_bloat", "full")])]
    out = analysis.generate_prompts(spark.createDataFrame(rows, FINDINGS)).orderBy("n").collect()
    assert [r["pattern"] for r in out] == ["near_duplicate_tool_calls", "model_mismatch", "odd"]
    assert "4 times" in out[0]["prompt"] and "gpt-5-nano" in out[1]["prompt"] and "(odd): what?" in out[2]["prompt"]
    assert analysis.generate_prompts(spark.createDataFrame([], FINDINGS)).count() == 0


def test_analyze(spark):
    t = session(spark, "cron", "o3", [("user", "hi"), ("assistant", "yes")], input_tokens=100)
    r = analysis.analyze(t).first()
    assert r["report"].startswith("Session cron:") and len(r["prompts"]) == 2


@pytest.mark.parametrize("empty", [True])
def test_no_sessions(spark, empty):
    t = session(spark, "s", "x", [("user", "a")])
    t = Tables(t.sessions.limit(0), t.messages.limit(0))
    assert analysis.analyze(t).count() == 0


def test_very_many_equal_responses(spark):
    """20,000 equal responses, 3 of another kind that share most of their lines, and one of its own: in closed form."""
    line = "the same line of more than twenty characters " * 6
    n = 20_000
    text = F.when(F.col("id") < n, f"{line}\n{line}a").when(F.col("id") < n + 3, F.concat(F.lit(f"{line}\n"), F.lit("another line of its own kind"))).otherwise("something else " * 30)
    m = spark.range(n + 4).select(F.lit("s").alias("session_id"), F.col("id").alias("idx"), F.lit("tool").alias("role"), text.alias("content"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast(CALLS).alias("tool_calls"))
    s = spark.createDataFrame([("s", "o3", n, n, 10, 0, 0.0)], "session_id string, model string, message_count long, tool_call_count long, input_tokens long, output_tokens long, cost_usd double")
    k, extra = len(line.strip()), len("another line of its own kind")
    r = bloat.stale(Tables(s, m)).first()
    same, pair = n * (n - 1) // 2, 3 * n
    assert r["count"] == same + pair + 3
    assert r["tokens_wasted"] == same * ((k + len(line) + 1) // 4) + pair * (k // 4) + 3 * ((k + extra) // 4)
    assert bloat.response_classes(Tables(s, m)).count() == 3


def test_texts_are_read_once(spark, monkeypatch):
    """Of all detectors' plans only that of the facts holds the texts."""
    t = session(spark, "s", "claude-opus-4-8", [("user", "any updates?"), ("assistant", "no", None, CALL), ("tool", "line " * 100, "read_file")])
    plans = []
    real = registry.written

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return real(df, name)

    from thriftlens.operators import facts

    for module in (registry, facts, bloat):
        monkeypatch.setattr(module, "written", seen)
    assert {r["pattern"] for r in analysis.run_analysis(t).collect()} == {"model_mismatch"}
    assert sorted(n for n, plan in plans if "content#" in plan) == ["facts"]


def test_a_built_in_detector_that_fails_while_it_runs(spark, monkeypatch):
    def bad(t):
        return t.facts().select("session_id", F.lit(0).alias("emit_ord"), F.lit("p").alias("pattern"), F.expr("cast(raise_error('no') as bigint)").alias("tokens_wasted"), F.lit(1).cast("long").alias("count"), F.lit("d").alias("description"), F.lit(0.5).alias("confidence"))

    monkeypatch.setitem(registry._registry, "heartbeat_waste", bad)
    monkeypatch.setitem(registry._built_in, "heartbeat_waste", bad)
    m = [("user", "read it"), ("assistant", None, None, CALL), ("tool", "contents...", "read_file"), ("assistant", "", None, CALL), ("tool", "contents...", "read_file")]
    assert found(session(spark, "s", "claude-haiku-4.5", m)) == [("duplicate_tool_calls", 2, 1, 0.95)]


def test_strict_tables_have_all_findings_or_none(spark, monkeypatch):
    """A detector that fails on one session, can't be planned or isn't known ends the analysis; those that don't fail give all they find."""

    def picky(s, messages):
        if s["model"] == "bad":
            raise ValueError("no")
        return [{"pattern": "picky", "tokens_wasted": 1, "count": 1, "description": ""}]

    def broken(t):
        raise RuntimeError("no plan")

    monkeypatch.setitem(registry._registry, "picky", registry.per_session(picky))
    monkeypatch.setitem(registry._registry, "broken", broken)
    good, bad = (session(spark, f"cron_{m}", m, [("user", "a")]) for m in ("o3", "bad"))
    one, two = (Tables(t.sessions, t.messages, strict=True) for t in (good, both(good, bad)))
    assert found(one, ["picky", "model_mismatch", "heartbeat_waste"]) == found(good, ["picky", "model_mismatch", "heartbeat_waste"]) != []
    for t, names, named in ((two, ["model_mismatch", "picky"], "picky"), (one, ["broken", "picky"], "broken"), (one, ["picky", "nope"], "nope")):
        with pytest.raises(registry.DetectorError, match=named):
            analysis.run_analysis(t, names)
    with pytest.raises(registry.DetectorError, match="(?s)broken.*picky"):
        analysis.analyze(two, ["broken", "picky"])
