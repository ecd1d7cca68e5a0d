"""What must not grow faster than the input: how often a text is read, what goes to Python, what one task reads."""

import sys
import unicodedata

from pyspark.sql import functions as F

from thriftlens import queries
from thriftlens.functions import text
from thriftlens.operators import bloat, duplicates, facts
from thriftlens.operators.tables import Tables
from thriftlens.plans import requests
from thriftlens.schema import DEFAULT
from thriftlens.sources import adapters


def test_a_document_that_answers_many_events_is_read_once(spark, tables, monkeypatch):
    given, hashed = [], facts._hashed
    monkeypatch.setattr(facts, "_hashed", lambda rows, least: given.append(rows.count()) or hashed(rows, least))
    t = adapters.agents(spark, tables, lines=True)
    assert sum(given) == spark.read.parquet(f"{tables}/documents.parquet").count()
    assert t.lines().count() > sum(given)


def test_lines_of_one_set_alone_decide_no_pair(spark):
    line = lambda x: f"a line of {x} " + "=" * 150
    texts = [line("a") + "\n" + line("b"), line("a") + "\n" + line("b") + "\n" + line("c"), line("d") * 3, line("d") * 3, line("a") + "\n" + line("e"), "x" * 300 + "\n", "short"]
    rows = [("s", i, "tool", x, None) for i, x in enumerate(texts)]
    messages = spark.createDataFrame(rows, "session_id string, idx long, role string, content string, tool_name string")
    table = facts.facts_and_lines(messages, DEFAULT, False)
    some = facts.sharable(table)
    assert some.agg(F.sum(F.size("lines"))).first()[0] < table.where("lines is not null").agg(F.sum(F.size("lines"))).first()[0]
    pairs = lambda rows: sorted(map(tuple, bloat.overlap_pairs(Tables(None, messages, table=rows, has_lines=True)).collect()))
    assert pairs(some) == pairs(table) and len(pairs(table)) == 2


def test_only_what_composition_may_change_goes_to_python(spark):
    ranges = [tuple(int(x, 16) for x in (r.split("-") * 2)[:2]) for r in text.COMPOSED.split()]
    held = {c for a, b in ranges for c in range(a, b + 1)}
    every = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    pairs = [unicodedata.decomposition(chr(c)).split() for c in every]
    second = {int(p[1], 16) for p in pairs if len(p) == 2 and not p[0].startswith("<")} | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    assert {c for c in every if unicodedata.combining(chr(c)) or unicodedata.normalize("NFC", chr(c)) != chr(c)} | second <= held
    settled = ["plain", "café über ł", "привет", "你好", "한국", "あ", "\U0001f600 ’"]
    changed = ["café", "한", "한", "Å", "が", "\U0001d15e", "ạ̇", "ạ̇"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(settled + changed)], "i int, v string")
    got = rows.select("v", text._composable(F.col("v")).alias("goes"), text.nfc("v").alias("o")).orderBy("i").collect()
    assert [r.goes for r in got] == [False] * len(settled) + [True] * len(changed)
    assert [r.o for r in got] == [unicodedata.normalize("NFC", r.v) for r in got]


def test_keys_need_one_python_step(spark):
    log = spark.createDataFrame([(1, "m", False, [("user", "café")]), (2, "m", False, None), (3, "m", True, [])], "request_id long, model string, streaming boolean, messages array<struct<role:string,content:string>>")
    rows = requests.keyed(log).where("cacheable").select("request_id", "key")
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r.request_id for r in rows.collect()] == [1]


def test_windows_are_read_from_more_than_one_file(spark, tables, agrees, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "fresh_path", lambda spark, name: f"file://{tmp_path}/{name}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        agrees(queries.stats_by_window, queries.ORACLE_SQL["stats_by_window"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "requests").glob("*.parquet"))) > 4


def test_lines_go_with_no_event_and_sets_of_them_give_the_same_pairs(spark, tables):
    t = adapters.agents(spark, tables, lines=True)
    assert "lines" not in t.table.columns and t.sets.columns == ["f1", "f2", "lines"]
    line = lambda x: f"a line of {x} " + "=" * 150
    texts = [line("a") + "\n" + line("b"), line("a") + "\n" + line("b") + "\n" + line("c"), line("d") * 3, line("d") * 3, line("a") + "\n" + line("b"), "x" * 300 + "\n", "short"]
    rows = [(s, i, "tool", x, None) for s in "st" for i, x in enumerate(texts)]
    messages = spark.createDataFrame(rows, "session_id string, idx long, role string, content string, tool_name string")
    table = facts.facts_and_lines(messages, DEFAULT, False)
    of_sets = Tables(None, messages, table=table.drop("lines"), has_lines=True, sets=facts.shared_sets(table))
    # d's line is in one set only, whose two members are a pair all the same
    for what, n in ((bloat.overlap_pairs, 8), (bloat.stale, 2)):
        got, want = (sorted(map(tuple, what(x).collect())) for x in (of_sets, Tables(None, messages, table=table, has_lines=True)))
        assert got == want and len(got) == n


def test_calls_are_aggregated_without_a_sort(spark):
    rows = [("s", 4, 0, "b", "{}"), ("s", -3, 1, "b", "1"), ("s", -3, 0, "b", "2"), ("s", 5, 0, "b", "1"), ("s", 6, 0, "b", "2"), ("s", 7, 2, "a", "x")]
    calls = spark.createDataFrame(rows, "session_id string, idx long, call_pos int, name string, arguments string")
    messages = spark.createDataFrame([("s", 0, "tool", "12345678", "b")], "session_id string, idx long, role string, content string, tool_name string")
    per = duplicates._per_tool(Tables(None, messages, calls=calls))
    assert "SortAggregate" not in per._jdf.queryExecution().executedPlan().toString()
    got = {r["name"]: r for r in per.collect()}
    assert [got["b"][c] for c in ("calls", "spare", "groups")] == [5, 2, 2] and got["a"]["most"] is None
    # of two groups of two the earlier one, by idx and then by the place in the message
    assert got["b"]["most"]["n"] == 2 and -int(got["b"]["most"]["p"]) == int(got["b"]["place"]) == -3 * (1 << 31)


def test_questions_facts_are_constants(spark):
    from pyspark.sql import functions as F

    df = spark.range(7).select(facts.facts_of_literals(adapters.PHRASES, (F.col("id") + 1).cast("int")).alias("f"), F.element_at(F.array(*map(F.lit, adapters.PHRASES)), (F.col("id") + 1).cast("int")).alias("p"))
    plan = df.select("f")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper()
    assert df.where(~((F.col("f.chars") == F.length("p")) & (F.col("f.tokens") == text.tokens("p")) & (F.col("f.idle") == text.idle("p")))).count() == 0
