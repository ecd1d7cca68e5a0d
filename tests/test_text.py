import pytest
from pyspark.sql import functions as F

from thriftlens.functions import text


def one(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).orderBy("i").collect()
    out = [r["o"] for r in rows]
    return out[0] if len(out) == 1 else out


CLEAN = [
    ("café", "café"),
    ("a\r\nb\rc\n", "a\nb\nc"),
    ("hello   \nworld\t\n", "hello\nworld"),
    ("a\n\n\n\n\nb", "a\n\nb"),
    ("a\n\nb", "a\n\nb"),
    ("  x \x1c\n", "x"),
    ("id 123E4567-e89b-12d3-a456-426614174000.", "id [UUID]."),
    ("at 2026-07-10T14:30:00Z", "at [TIMESTAMP]"),
    ("at 2026-07-10T14:30:00.123+02:00 now", "at [TIMESTAMP] now"),
    ("at 2026-07-10T14:30:00 no zone", "at 2026-07-10T14:30:00 no zone"),
    ("on 2026-07-10", "on [DATE]"),
    ("12026-07-10 no", "12026-07-10 no"),
    ("", ""),
]


def test_clean(spark):
    assert one(spark, text.clean, *[c[0] for c in CLEAN]) == [c[1] for c in CLEAN]
    assert one(spark, text.clean, None, "x") == [None, "x"]
    kept = one(spark, lambda c: text.clean(c, strip_volatile=False), "on 2026-07-10  \n")
    assert kept == "on 2026-07-10"


def test_nfc_leaves_ascii_alone_and_composes_the_rest(spark):
    assert one(spark, text.nfc, "abc", "é", "Å") == ["abc", "é", "Å"]


def test_normalized_messages(spark):
    m = [[("developer", "x\r\n"), ("user", None), (None, "é 2026-01-02"), ("tool", "  ")], [], None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(m)], "i int, m array<struct<role:string,content:string>>")
    out = [r["m"] for r in df.select("i", text.normalized(F.col("m")).alias("m")).orderBy("i").collect()]
    assert [tuple(x) for x in out[0]] == [("system", "x"), ("user", ""), ("user", "é [DATE]"), ("tool", "")]
    assert out[1:] == [[], None]


def test_tokens(spark):
    assert one(spark, text.tokens, "", "abc", "abcdefgh", None) == [1, 1, 2, 1]
    assert one(spark, text.tokens_from_zero, "", "abc", "abcdefgh", None) == [0, 0, 2, 0]


def test_arguments(spark):
    same = one(spark, text.canonical_arguments, '{"b": 1, "a": {"d": 2, "c": [1,2]}}', '{"a":{"c":[1, 2],"d":2},"b":1}')
    assert same[0] == same[1]
    assert one(spark, text.canonical_arguments, "  ls   -l\n", "", None) == ["ls -l", "", ""]


def test_capped(spark):
    out = one(spark, text.capped, "x" * 8000, "x" * 6000, None)
    assert len(out[0]) == 6032 and out[0].endswith("\n[... truncated from 8000 chars]") and out[1] == "x" * 6000 and out[2] is None


@pytest.mark.parametrize("s", ["Still running?", "no updates", "Nothing new here", "checking in", "all clear", "polling", "any news?", "any news?\n", "Health check of db", "status  check"])
def test_idle(spark, s):
    assert one(spark, text.idle, s)


@pytest.mark.parametrize("s", ["any news? tell me", "the health check", "do it", "", "énothing newé", "distill runningx"])
def test_not_idle(spark, s):
    assert not one(spark, text.idle, s)


def test_scheduled(spark):
    assert one(spark, text.scheduled, "CRON_daily", "a-health-check", "schedule", "chat", "polling") == [True, True, True, False, True]


def test_lines(spark):
    out = one(spark, text.shared_lines, "  a line of more than twenty  \r\nshort\x0ba line of more than twenty another line, long enough")
    assert out == ["a line of more than twenty", "another line, long enough"]


def test_names_in_descriptions(spark):
    assert one(spark, text.tool_named, "Bash was called", "read_file twice", "read_files", "rebash") == ["bash", "read_file", "the tool", "the tool"]
    models = one(spark, text.cheaper_named, "from o3 to claude-haiku-4.5 now", "to nowhere; gpt-4.1-nano or gpt-5-mini", "deepseek-v3", "deepseek-v31", "nothing")
    assert models == ["claude-haiku-4.5", "gpt-5-mini", "deepseek-v3", "a cheaper model", "a cheaper model"]


def test_tool_names(spark):
    assert one(spark, text.tool_names, '{"name": "a"} {"name":"b_1"} {"name": "a"} {"name": "no-hit"}') == ["a", "b_1"]
