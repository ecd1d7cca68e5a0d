"""Every operator as a query over the synthetic tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thriftlens.functions import pricing, text
from thriftlens.operators import bloat, duplicates, heartbeat, mismatch
from thriftlens.operators.tables import Tables
from thriftlens.plans import accounting, analysis, compress, requests
from thriftlens.sources import adapters, database, dumps, resolve
from thriftlens.storage import fresh_path, table
from thriftlens.streaming import requests as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- SQL pieces ------------------------------------------------------------------------------------------------


def _values(rows: list[tuple]) -> str:
    one = lambda x: "NULL" if x is None else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TOKENS = "greatest(1, length({0}) // 4)"
_PRICES = f"""
prices(ord, known, input, output, provider) AS (VALUES {_values([(i, *p) for i, p in enumerate(pricing.PRICES)])}),
cheap(provider, cheapest) AS (VALUES {_values(pricing.CHEAPEST)}),
"""
_RESOLVED = """
resolved AS (
  SELECT model, input, output, provider FROM (
    SELECT m.model, p.*, row_number() OVER (PARTITION BY m.model ORDER BY m.model <> p.known, p.ord) AS r
    FROM (SELECT DISTINCT model FROM sessions WHERE model IS NOT NULL) AS m
    JOIN prices AS p ON starts_with(m.model, p.known) OR starts_with(p.known, m.model)
  ) WHERE r = 1
),
priced AS (
  SELECT r.*, c.cheapest, p.input AS cheapest_input
  FROM resolved AS r LEFT JOIN cheap AS c USING (provider) LEFT JOIN prices AS p ON p.known = c.cheapest
),
"""
_MODELS = "['" + "', '".join(adapters.MODELS) + "']"
_METRICS = """
metrics AS (
  SELECT session_id, count(*) AS message_count, CAST(sum(length(content) // 4) AS BIGINT) AS input_tokens
  FROM messages GROUP BY session_id
),
"""
_CONV = f"""
messages AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS idx, role, coalesce(text, '') AS content, NULL AS tool_name, 0 AS n_calls FROM conversations),
{_METRICS}
sessions AS (SELECT *, {_MODELS}[(CAST(session_id AS BIGINT) % {len(adapters.MODELS)}) + 1] AS model FROM metrics),
"""
_DOCS = f"""
messages AS (SELECT {{session}} AS session_id, doc_id AS idx, 'tool' AS role, coalesce(text, '') AS content, source AS tool_name, 0 AS n_calls FROM documents),
{_METRICS}
sessions AS (SELECT *, 'claude-opus-4-8' AS model FROM metrics),
"""
_AGENTS = f"""
ev AS (SELECT CASE WHEN user_id % 5 = 0 THEN 'cron_' ELSE 's_' END || user_id AS session_id, user_id, event_id, event_type, {{args}} AS args FROM events),
calls AS (SELECT session_id, event_id * 3 + 1 AS idx, event_type AS name, replace(args, ': ', ':') AS norm_args FROM ev),
messages AS (
  SELECT session_id, event_id * 3 AS idx, 'user' AS role, ['{"', '".join(adapters.PHRASES)}'][event_id % 7 + 1] AS content, NULL AS tool_name, 0 AS n_calls FROM ev
  UNION ALL SELECT session_id, event_id * 3 + 1, 'assistant', '', NULL, 1 FROM ev
  UNION ALL SELECT session_id, event_id * 3 + 2, 'tool', coalesce(text, ''), event_type, 0 FROM ev JOIN documents AS d ON d.doc_id = ev.event_id % (SELECT count(*) FROM documents)
  UNION ALL SELECT DISTINCT session_id, -1, 'system', (SELECT string_agg('{{{{"name": "' || t || '"}}}}', chr(10) ORDER BY k, t) FROM (SELECT DISTINCT event_type AS t, 0 AS k FROM events UNION ALL SELECT 'spare_a', 1 UNION ALL SELECT 'spare_b', 1)), NULL, 0 FROM ev
),
{_METRICS}
sessions AS (SELECT *, {_MODELS}[(CAST(regexp_extract(session_id, '[0-9]+$') AS BIGINT) % {len(adapters.MODELS)}) + 1] AS model FROM metrics),
"""
_DUPLICATES = f"""
by_name AS (SELECT session_id, tool_name AS name, sum({_TOKENS.format('content')}) // count(*) AS t FROM messages WHERE role = 'tool' GROUP BY 1, 2),
by_session AS (SELECT session_id, sum({_TOKENS.format('content')}) // count(*) AS t FROM messages WHERE role = 'tool' GROUP BY 1),
groups AS (
  SELECT g.*, CAST(coalesce(a.t, b.t, 100) AS BIGINT) AS resp, CAST((n - 1) * coalesce(a.t, b.t, 100) AS BIGINT) AS wasted
  FROM (SELECT session_id, name, norm_args, count(*) AS n, min(idx) AS first_idx FROM calls GROUP BY 1, 2, 3 HAVING count(*) >= 2) AS g
  LEFT JOIN by_name AS a USING (session_id, name) LEFT JOIN by_session AS b USING (session_id)
),
names AS (
  SELECT n.*, CAST(coalesce(a.t, b.t, 100) AS BIGINT) AS resp, row_number() OVER (PARTITION BY n.session_id ORDER BY n DESC, first_idx) AS r
  FROM (SELECT session_id, name, count(*) AS n, min(idx) AS first_idx FROM calls GROUP BY 1, 2 HAVING count(*) >= 3) AS n
  LEFT JOIN by_name AS a USING (session_id, name) LEFT JOIN by_session AS b USING (session_id)
),
exact AS (
  SELECT session_id, 0 AS emit_ord, 'duplicate_tool_calls' AS pattern, CAST(sum(wasted) AS BIGINT) AS tokens_wasted, count(*) AS count, 0.95::DOUBLE AS confidence,
         arg_max(name || ' was called ' || n, {{'w': wasted, 'i': -first_idx}}) || ' times with the same arguments (' || count(*) || ' repeated ' || CASE WHEN count(*) = 1 THEN 'call' ELSE 'calls' END || ' in all)' AS description
  FROM groups GROUP BY session_id
),
near AS (
  SELECT session_id, 1 AS emit_ord, 'near_duplicate_tool_calls' AS pattern,
         CAST(sum(CASE WHEN r <= 3 THEN CAST(floor((n - 1) * resp * 0.3::DOUBLE) AS BIGINT) END) AS BIGINT) AS tokens_wasted, CAST(sum(n) AS BIGINT) AS count, 0.5::DOUBLE AS confidence,
         'the same tools were called again and again with other arguments: ' || string_agg(name || ' (' || n || ' times)', ', ' ORDER BY r) FILTER (WHERE r <= 3) || '; about 30% of that is likely redundant' AS description
  FROM names GROUP BY session_id
),
near_only AS (SELECT * FROM near WHERE tokens_wasted > 0 AND session_id NOT IN (SELECT session_id FROM exact)),
"""
_STALE = f"""
lines AS (
  SELECT DISTINCT session_id, idx, trim(l, {_WS}) AS line
  FROM (SELECT * FROM messages WHERE role = 'tool' AND length(content) > 200), unnest(string_split(content, chr(10))) AS t(l)
  WHERE length(trim(l, {_WS})) > 20
),
pairs AS (
  SELECT a.session_id, a.idx AS i, b.idx AS j, CAST(sum(length(a.line)) AS BIGINT) AS overlap
  FROM lines AS a JOIN lines AS b ON a.session_id = b.session_id AND a.line = b.line AND a.idx < b.idx
  GROUP BY 1, 2, 3 HAVING sum(length(a.line)) > 200
),
stale AS (
  SELECT session_id, 0 AS emit_ord, 'context_bloat' AS pattern, CAST(sum(overlap // 4) AS BIGINT) AS tokens_wasted, count(*) AS count, 0.65::DOUBLE AS confidence,
         count(*) || ' pairs of tool responses hold the same content, so it was read more than once' AS description
  FROM pairs GROUP BY 1 HAVING count(*) >= 2
),
"""
_OVERSIZED = """
oversized AS (
  SELECT session_id, 1 AS emit_ord, 'context_bloat' AS pattern, CAST(sum((length(content) - 5000) // 4) AS BIGINT) AS tokens_wasted, count(*) AS count, 0.55::DOUBLE AS confidence,
         count(*) || ' tool ' || CASE WHEN count(*) = 1 THEN 'response is' ELSE 'responses are' END || ' longer than 5,000 characters (the first, from ' || arg_min(coalesce(tool_name, 'unknown') || ', by ' || format('{:,}', length(content) - 5000), idx) || '); limit the lines that are read' AS description
  FROM messages WHERE role = 'tool' AND length(content) > 5000 GROUP BY 1
),
"""
_UNUSED = """
defined AS (SELECT session_id, list_distinct(regexp_extract_all(arg_min(content, idx), '"name":\\s*"(\\w+)"', 1)) AS available FROM messages WHERE role = 'system' GROUP BY 1),
unused AS (
  SELECT d.session_id, len(available) AS available, list_sort(list_filter(available, lambda x: NOT list_contains(coalesce(used, []), x))) AS unused
  FROM defined AS d LEFT JOIN (SELECT session_id, list(DISTINCT name) AS used FROM calls GROUP BY 1) AS c USING (session_id) WHERE len(available) >= 5
),
unused_tools AS (
  SELECT session_id, 2 AS emit_ord, 'context_bloat' AS pattern, CAST(len(unused) * 500 AS BIGINT) AS tokens_wasted, len(unused) AS count, 0.7::DOUBLE AS confidence,
         len(unused) || ' defined ' || CASE WHEN len(unused) = 1 THEN 'tool was' ELSE 'tools were' END || ' never used (' || array_to_string(unused[1:3], ', ') || CASE WHEN len(unused) > 3 THEN ' and others' ELSE '' END || '); leave them out of the system prompt' AS description
  FROM unused WHERE len(unused) > 0
),
"""
_OVERHEAD = """
overhead AS (
  SELECT s.session_id, 3 AS emit_ord, 'context_bloat' AS pattern, CAST(floor(input_tokens * 0.25::DOUBLE) AS BIGINT) AS tokens_wasted, message_count AS count, 0.4::DOUBLE AS confidence,
         'the session has ' || message_count || ' messages, of which about a quarter is overhead; start afresh now and then' AS description
  FROM sessions AS s LEFT JOIN (SELECT session_id, sum(tokens_wasted) AS known FROM ({found}) GROUP BY 1) AS k USING (session_id)
  WHERE message_count > 30 AND (known IS NULL OR known < floor(input_tokens * 0.25::DOUBLE) * 0.5::DOUBLE)
),
"""
_MISMATCH = f"""
ahead AS (
  SELECT *, lead(role, 1) OVER w AS r1, lead(content, 1) OVER w AS c1, lead(n_calls, 1) OVER w AS n1,
         lead(role, 2) OVER w AS r2, lead(content, 2) OVER w AS c2, lead(n_calls, 2) OVER w AS n2
  FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY idx)
),
answered AS (
  SELECT session_id, idx, content AS q, CASE WHEN r1 = 'assistant' THEN c1 WHEN r2 = 'assistant' THEN c2 END AS a, CASE WHEN r1 = 'assistant' THEN n1 WHEN r2 = 'assistant' THEN n2 END AS n
  FROM ahead WHERE role = 'user'
),
simple AS (
  SELECT session_id, count(*) AS n, sum({_TOKENS.format('q')} + {_TOKENS.format('a')}) AS t
  FROM answered WHERE a IS NOT NULL AND length(a) < 300 AND (length(q) < 500 OR n = 0) GROUP BY 1
),
mismatch AS (
  SELECT session_id, 0 AS emit_ord, 'model_mismatch' AS pattern, CAST(floor(t * ((input - cheapest_input) / input)) AS BIGINT) AS tokens_wasted, n AS count, 0.7::DOUBLE AS confidence,
         n || ' simple ' || CASE WHEN n = 1 THEN 'query' ELSE 'queries' END || ' went to ' || model || printf(' ($%.2f per 1M input tokens); switch to ', input) || cheapest || printf(' ($%.2f) for the like', cheapest_input) AS description
  FROM simple JOIN sessions AS s USING (session_id) JOIN priced AS p USING (model)
  WHERE model <> 'unknown' AND input > 1.0 AND input - cheapest_input > 0
),
"""
_IDLE_SQL = r"still (running|alive|active|working)\b|\bno (changes?|updates?|news?|output)\b|\bnothing (to|new|changed|happened)\b|\bchecking (in|status|progress)\b|\bstill nothing\b|\ball (clear|good|quiet|normal)\b|\b(polling|watching)\b|\bany (updates?|changes?|news?)\?$|^(health|status)\s*check"
_HEARTBEAT = f"""
idles AS (
  SELECT session_id, count(*) AS users, count(*) FILTER (WHERE hit) AS idle, coalesce(sum({_TOKENS.format('content')}) FILTER (WHERE hit), 0) AS idle_tokens
  FROM (SELECT *, regexp_matches(content, '{_IDLE_SQL}', 'i') AS hit FROM messages WHERE role = 'user') GROUP BY 1
),
beats AS (
  SELECT s.session_id, s.model, s.input_tokens, regexp_matches(s.session_id, 'cron|scheduled?|heartbeat|health.?check|monitor|poll', 'i') AS scheduled,
         coalesce(users, 0) AS users, coalesce(idle, 0) AS idle, coalesce(idle_tokens, 0) AS idle_tokens
  FROM sessions AS s LEFT JOIN idles USING (session_id)
),
cron AS (
  SELECT session_id, 0 AS emit_ord, 'heartbeat_waste' AS pattern, CAST(floor(input_tokens * ((input - cheapest_input) / input)) AS BIGINT) AS tokens_wasted, CAST(idle AS BIGINT) AS count, 0.75::DOUBLE AS confidence,
         'the session looks like a scheduled check on ' || model || '; switch it to ' || cheapest || printf(' (about $%.2f less per 1M input tokens)', input - cheapest_input) AS description
  FROM beats JOIN priced USING (model) WHERE scheduled AND cheapest <> model AND input - cheapest_input > 0
),
idle AS (
  SELECT session_id, 1 AS emit_ord, 'heartbeat_waste' AS pattern, CAST(idle_tokens AS BIGINT) AS tokens_wasted, CAST(idle AS BIGINT) AS count, 0.5::DOUBLE AS confidence,
         idle || ' user messages only ask whether anything has happened; batch them or use a cheaper model' AS description
  FROM beats WHERE NOT scheduled AND idle >= 2 AND users > 0 AND idle >= users * 0.5
),
"""
_FOUND = "SELECT * FROM stale UNION ALL SELECT * FROM oversized UNION ALL SELECT * FROM unused_tools"
_ALL = f"""
WITH {_AGENTS.format(args='props')} {_PRICES} {_RESOLVED} {_DUPLICATES} {_STALE} {_OVERSIZED} {_UNUSED} {_OVERHEAD.format(found=_FOUND)} {_MISMATCH} {_HEARTBEAT}
found AS (
  SELECT 0 AS det_ord, 'context_bloat' AS detector, * FROM ({_FOUND} UNION ALL SELECT * FROM overhead)
  UNION ALL SELECT 1, 'duplicate_tool_calls', * FROM (SELECT * FROM exact UNION ALL SELECT * FROM near_only)
  UNION ALL SELECT 2, 'heartbeat_waste', * FROM (SELECT * FROM cron UNION ALL SELECT * FROM idle)
  UNION ALL SELECT 3, 'model_mismatch', * FROM mismatch
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tokens_wasted * confidence DESC, det_ord, emit_ord) AS rank FROM found)
"""
_FINDING = "session_id, pattern, tokens_wasted, count, confidence, description"
_COLUMNS = ["session_id", "pattern", "tokens_wasted", "count", "confidence", "description"]


# --- detectors -------------------------------------------------------------------------------------------------


@query(f"WITH {_AGENTS.format(args='props')} {_DUPLICATES} done AS (SELECT 1) SELECT session_id, name, norm_args, n, resp, wasted FROM groups")
def dup_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_groups(adapters.agents(spark, sf_dir)).select("session_id", "name", "norm_args", "n", "resp", "wasted")


@query(f"WITH {_AGENTS.format(args='props')} {_DUPLICATES} done AS (SELECT 1) SELECT {_FINDING} FROM exact")
def dup_exact_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact(adapters.agents(spark, sf_dir)).select(*_COLUMNS)


@query(f"WITH {_AGENTS.format(args=chr(39) + '#' + chr(39) + ' || event_id')} {_DUPLICATES} done AS (SELECT 1) SELECT {_FINDING} FROM near_only")
def dup_near_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.near(adapters.agents(spark, sf_dir, unique_arguments=True)).select(*_COLUMNS)


@query(f"WITH {_DOCS.format(session='lang')} {_STALE} done AS (SELECT 1) SELECT session_id, i, j, overlap FROM pairs")
def stale_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloat.overlap_pairs(adapters.documents(spark, sf_dir))


@query(f"WITH {_DOCS.format(session='lang')} {_STALE} done AS (SELECT 1) SELECT {_FINDING} FROM stale")
def stale_overlap_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloat.stale(adapters.documents(spark, sf_dir)).select(*_COLUMNS)


@query(f"WITH {_DOCS.format(session='lang')} {_OVERSIZED} done AS (SELECT 1) SELECT {_FINDING} FROM oversized")
def oversized_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloat.oversized(adapters.documents(spark, sf_dir)).select(*_COLUMNS)


@query(f"WITH {_AGENTS.format(args='props')} {_UNUSED} done AS (SELECT 1) SELECT session_id, CAST(available AS BIGINT) AS available, array_to_string(unused, ',') AS unused FROM unused WHERE len(unused) > 0")
def unused_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloat.unused(adapters.agents(spark, sf_dir)).select("session_id", F.col("available").cast("long").alias("available"), F.array_join("unused", ",").alias("unused"))


@query(f"WITH {_DOCS.format(session='source')} {_STALE} {_OVERSIZED} {_OVERHEAD.format(found='SELECT * FROM stale UNION ALL SELECT * FROM oversized')} done AS (SELECT 1) SELECT {_FINDING} FROM overhead")
def session_overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = adapters.documents(spark, sf_dir, "source")
    return bloat.overhead(t, bloat.stale(t).unionByName(bloat.oversized(t)).unionByName(bloat.unused_tools(t))).select(*_COLUMNS)


@query(f"WITH {_CONV} {_PRICES} {_RESOLVED} {_MISMATCH} done AS (SELECT 1) SELECT {_FINDING} FROM mismatch")
def mismatch_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mismatch.detect(adapters.conversations(spark, sf_dir)).select(*_COLUMNS)


@query(f"WITH {_AGENTS.format(args='props')} {_PRICES} {_RESOLVED} {_HEARTBEAT} done AS (SELECT 1) SELECT {_FINDING} FROM cron")
def heartbeat_cron(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heartbeat.scheduled(adapters.agents(spark, sf_dir)).select(*_COLUMNS)


@query(f"WITH {_AGENTS.format(args='props')} {_PRICES} {_RESOLVED} {_HEARTBEAT} done AS (SELECT 1) SELECT {_FINDING} FROM idle")
def heartbeat_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heartbeat.idle(adapters.agents(spark, sf_dir)).select(*_COLUMNS)


# --- analysis --------------------------------------------------------------------------------------------------


def _agents(spark: SparkSession, sf_dir: str) -> Tables:
    """The agents' tables for all detectors. Where one fails the query fails, as its findings would be missing from the result."""
    return replace(adapters.agents(spark, sf_dir, lines=True), strict=True)


@query(f"{_ALL} SELECT {_FINDING}, detector, rank FROM ranked")
def ranked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.run_analysis(_agents(spark, sf_dir)).select(*_COLUMNS, "detector", F.col("rank").cast("long").alias("rank"))


@query(f"{_ALL} SELECT {_FINDING}, rank FROM ranked WHERE rank <= 3")
def top3_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.run_analysis(_agents(spark, sf_dir)).where("rank <= 3").select(*_COLUMNS, F.col("rank").cast("long").alias("rank"))


@query(f"""{_ALL} SELECT s.session_id, s.input_tokens AS total_tokens, CASE WHEN s.input_tokens > 0 THEN s.input_tokens / 1e6::DOUBLE END AS cost, coalesce(w, 0) AS wasted,
CASE WHEN s.input_tokens > 0 AND w > 0 THEN least(99, CAST(floor(w / s.input_tokens * 100) AS BIGINT)) END AS waste_pct
FROM sessions AS s LEFT JOIN (SELECT session_id, CAST(sum(tokens_wasted) AS BIGINT) AS w FROM found GROUP BY 1) USING (session_id)""")
def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _agents(spark, sf_dir)
    return analysis.summary(t.sessions, analysis.run_analysis(t))


_COMMAS = "format('{{:,}}', {0})"


@query(f"""{_ALL}, wasted AS (SELECT session_id, sum(tokens_wasted) AS w FROM found GROUP BY 1),
body AS (SELECT session_id, string_agg('  ' || rank || '. ' || pattern || ' (' || count || 'x): ~' || {_COMMAS.format("tokens_wasted")} || ' tokens — ' || replace(description, chr(10), chr(10) || '      '), chr(10) ORDER BY rank) AS lines FROM ranked WHERE rank <= 3 GROUP BY 1)
SELECT s.session_id, 'Session ' || s.session_id || ': ' || {_COMMAS.format("input_tokens")} || ' tokens, '
|| CASE WHEN input_tokens > 0 THEN '~$' || (input_tokens + 5000) // 1000000 || '.' || lpad(CAST((input_tokens + 5000) // 10000 % 100 AS VARCHAR), 2, '0') ELSE 'unknown' END
|| CASE WHEN input_tokens > 0 AND w > 0 THEN ', ' || least(99, CAST(floor(w / input_tokens * 100) AS BIGINT)) || '% avoidable.' WHEN w > 0 THEN ', ~' || {_COMMAS.format("w")} || ' tokens waste.' ELSE '. No significant waste detected.' END
|| coalesce(chr(10) || chr(10) || 'Top wastes:' || chr(10) || lines, '') AS report
FROM sessions AS s LEFT JOIN wasted USING (session_id) LEFT JOIN body USING (session_id)""")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of every session."""
    t = _agents(spark, sf_dir)
    return analysis.format_output(t.sessions, analysis.run_analysis(t))


_CHEAP_SQL = text.CHEAP.replace(r"(?!\d)", "")
_SLOTS = rf"""
said AS (SELECT *, lower(description) AS low, regexp_extract(description, '\bto\s+([a-z][a-z0-9.-]*[a-z0-9])', 1, 'i') AS after, regexp_extract_all(description, '{_CHEAP_SQL}', 1, 'i') AS named FROM ranked),
slots AS (
  SELECT *, CASE {' '.join(rf"WHEN regexp_matches(low, '{chr(92)}b{t}{chr(92)}b') THEN '{t}'" for t in text.TOOLS)} ELSE 'the tool' END AS tool,
         CASE WHEN regexp_matches(after, '^{_CHEAP_SQL}', 'i') THEN after ELSE coalesce(list_sort(list_transform(named, lambda x: {{'n': length(x), 'x': x}}))[1].x, 'a cheaper model') END AS cheaper
  FROM said
)
"""


@query(f"""{_ALL}, {_SLOTS}, advice(pattern, template) AS (VALUES {_values(list(analysis.ADVICE.items()))}),
based AS (SELECT *, row_number() OVER (PARTITION BY session_id, replace(pattern, 'near_', '') ORDER BY rank) AS k FROM slots),
numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rank) AS n FROM based WHERE k = 1)
SELECT session_id, n, pattern, replace(replace(replace(replace(template, '{{count}}', CAST(count AS VARCHAR)), '{{tool_name}}', tool), '{{cheaper_model}}', cheaper), '{{detail}}', description) AS prompt
FROM numbered JOIN advice USING (pattern) WHERE n <= 3""")
def advice_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.generate_prompts(analysis.run_analysis(_agents(spark, sf_dir)))
    return found.select("session_id", F.col("n").cast("long").alias("n"), "pattern", "prompt")


@query(f"{_ALL}, {_SLOTS} SELECT session_id, rank, tool, cheaper AS model FROM slots")
def advice_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool and the cheaper model that every finding's description names."""
    found = analysis.run_analysis(_agents(spark, sf_dir))
    return found.select("session_id", F.col("rank").cast("long").alias("rank"), text.tool_named("description").alias("tool"), text.cheaper_named("description").alias("model"))


# --- prices ----------------------------------------------------------------------------------------------------

_SUFFIXES = ["", "-2024-07-18", "-x"]
_NAMED = f"""
given AS (SELECT conv_id, {_MODELS}[conv_id % {len(adapters.MODELS)} + 1] || {_SUFFIXES}[conv_id // {len(adapters.MODELS)} % 3 + 1] AS whole FROM (SELECT DISTINCT conv_id FROM conversations)),
named AS (SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN whole[1:5 + conv_id % 7] ELSE whole END AS model FROM given),
sessions AS (SELECT DISTINCT model FROM named)
"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, model: a model for each conversation, with a date or other letters behind it, or cut off."""
    c = F.col("conv_id")
    suffix = F.element_at(F.array(*[F.lit(x) for x in _SUFFIXES]), (F.floor(c / len(adapters.MODELS)) % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("whole", F.concat(adapters.model_of(c), suffix))
    return rows.select("conv_id", F.when(c % 5 == 0, F.substring("whole", F.lit(1), (5 + c % 7).cast("int"))).otherwise(F.col("whole")).alias("model"))


@query(f"WITH {_NAMED}, {_PRICES} {_RESOLVED} done AS (SELECT 1) SELECT model, input, output, provider FROM resolved")
def model_price_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.resolved(_named(spark, sf_dir).select("model").distinct())


@query(f"WITH {_NAMED}, {_PRICES} {_RESOLVED} done AS (SELECT 1) SELECT model, provider, cheapest, input - cheapest_input AS saving FROM priced")
def cheapest_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.with_cheapest(_named(spark, sf_dir).select("model").distinct()).select("model", "provider", "cheapest", (F.col("input") - F.col("cheapest_input")).alias("saving"))


@query(f"""WITH {_NAMED}, {_PRICES} {_RESOLVED} counts AS (SELECT model, count(*) AS n FROM named GROUP BY model),
own AS (SELECT model, n % 4 / 1e7::DOUBLE * 1000000 AS input, n % 3 / 1e7::DOUBLE * 1000000 AS output, CASE WHEN n % 2 = 0 THEN 'elsewhere' ELSE 'unknown' END AS provider FROM counts WHERE n % 4 <> 0 OR n % 3 <> 0)
SELECT model, coalesce(o.input, r.input) AS input, coalesce(o.output, r.output) AS output, coalesce(o.provider, r.provider) AS provider FROM sessions LEFT JOIN own AS o USING (model) LEFT JOIN resolved AS r USING (model) WHERE coalesce(o.input, r.input) IS NOT NULL""")
def price_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of the user's own for each model, from how many conversations it has; without any, the known price stays."""
    per, n = _named(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n")), F.col("n")
    costs = per.select("model", (n % 4 / F.lit(1e7)).alias("input_cost_per_token"), (n % 3 / F.lit(1e7)).alias("output_cost_per_token"), F.when(n % 2 == 0, "elsewhere").alias("provider"))
    return pricing.resolved(per.select("model"), pricing.per_million(costs))


@query(f"WITH {_CONV} {_PRICES} {_RESOLVED} done AS (SELECT 1) SELECT session_id, model, round(input_tokens * 1000 / 1e6::DOUBLE * input + 10000 / 1e6::DOUBLE * output, 6) AS cost FROM sessions LEFT JOIN priced USING (model)")
def session_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.conversations(spark, sf_dir).sessions
    return s.join(pricing.resolved(s), "model", "left").select("session_id", "model", pricing.cost(F.col("input_tokens") * 1000, F.lit(10_000), F.col("input"), F.col("output")).alias("cost"))


# --- text ------------------------------------------------------------------------------------------------------

_TAIL = "  \r\n\r\n\r\n\r\n"
_NOISE_SQL = "(SELECT doc_id, text || '  ' || repeat(chr(13) || chr(10), 4) || regexp_replace(md5(CAST(doc_id AS VARCHAR)), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5') || ' 2024-01-02T03:04:05Z 2024-05-06T07:08:09 2024-01-02' || chr(10) || ' ' AS t FROM documents)"


def _noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    uuid = F.regexp_replace(F.md5(F.col("doc_id").cast("string").cast("binary")), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    t = F.concat(F.col("text"), F.lit(_TAIL), uuid, F.lit(" 2024-01-02T03:04:05Z 2024-05-06T07:08:09 2024-01-02\n "))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))


_STEPS = {
    "norm_line_ends": (text.line_ends, "regexp_replace({0}, '\\r\\n?', chr(10), 'g')"),
    "norm_trailing_blanks": (text.trailing_blanks, "regexp_replace({0}, '[ \\t]+\\n', chr(10), 'g')"),
    "norm_blank_lines": (text.blank_lines, "regexp_replace({0}, '\\n{{3,}}', chr(10) || chr(10), 'g')"),
    "norm_strip": (text.strip, f"trim({{0}}, {_WS})"),
    "norm_uuid": (text.uuids, "regexp_replace({0}, '\\b[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}\\b', '[UUID]', 'g')"),
    "norm_timestamp": (text.timestamps, "regexp_replace({0}, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(?:\\.\\d+)?(?:Z|[+-]\\d{{2}}:\\d{{2}})\\b', '[TIMESTAMP]', 'g')"),
    "norm_date": (text.dates, "regexp_replace({0}, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b', '[DATE]', 'g')"),
}
_CHAIN = "t"
for _name, (_f, _sql) in _STEPS.items():

    def _step(spark: SparkSession, sf_dir: str, f=_f) -> DataFrame:
        return _noise(spark, sf_dir).select("doc_id", f(F.col("t")).alias("t"))

    QUERIES[_name] = _step
    ORACLE_SQL[_name] = f"SELECT doc_id, {_sql.format('t')} AS t FROM {_NOISE_SQL}"
    _CHAIN = _sql.format(_CHAIN)


@query(f"SELECT doc_id, {_CHAIN} AS t FROM (SELECT doc_id, nfc_normalize(t) AS t FROM {_NOISE_SQL})")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noise(spark, sf_dir).select("doc_id", text.clean("t").alias("t"))


@query("SELECT doc_id, nfc_normalize(text || 'e' || chr(769) || ' A' || chr(778)) AS t FROM documents")
def norm_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.nfc(F.concat("text", F.lit("é Å"))).alias("t"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 2 = 1 THEN 'system' ELSE role END AS role FROM conversations")
def role_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    developer = F.when((F.col("role") == "user") & (F.col("turn") % 2 == 1), "developer").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.canonical_role(developer).alias("role"))


@query("SELECT request_id, CAST(i - 1 AS BIGINT) AS pos, m[i].role AS role, rtrim(m[i].content || chr(10) || '[DATE]', ' ') AS content FROM (SELECT conv_id * 2 + twin AS request_id, m FROM (SELECT conv_id, list({'role': role, 'content': coalesce(text, '')} ORDER BY turn) AS m FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id), unnest([0, 1]) AS v(twin)), unnest(range(1, len(m) + 1)) AS t(i)")
def normalize_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.requests(spark, sf_dir).select("request_id", F.posexplode(text.normalized(F.col("messages"))).alias("pos", "m"))
    return rows.select("request_id", F.col("pos").cast("long").alias("pos"), "m.role", "m.content")


@query(f"""SELECT conv_id, turn, CAST({_TOKENS.format("coalesce(text, '')")} AS BIGINT) AS at_least_one, length(coalesce(text, '')) // 4 AS from_zero,
CAST(sum({_TOKENS.format("coalesce(text, '')")}) OVER (PARTITION BY conv_id) AS BIGINT) AS of_list FROM conversations""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    lists = rows.groupBy("conv_id").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("ts")).select("conv_id", text.list_tokens(F.col("ts")).alias("of_list"))
    return rows.select("conv_id", "turn", text.tokens("text").alias("at_least_one"), text.tokens_from_zero("text").alias("from_zero")).join(lists, "conv_id")


_FILES = "(SELECT DISTINCT CASE conv_id % 4 WHEN 0 THEN 'request_dump_' || conv_id || '_214623_e95335_20260710_214753_463451' WHEN 1 THEN 'request_dump_' || conv_id || '_b' WHEN 2 THEN 'sample' || conv_id ELSE 'x.' || conv_id END || '.json' AS f FROM conversations)"


@query(f"SELECT f AS file, CASE WHEN starts_with(f, 'request_dump_') AND len(string_split(replace(replace(f, '.json', ''), 'request_dump_', ''), '_')) >= 3 THEN array_to_string(string_split(replace(replace(f, '.json', ''), 'request_dump_', ''), '_')[1:3], '_') ELSE replace(f, '.json', '') END AS session_id FROM {_FILES}")
def dump_session_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session that each of a folder's file names means."""
    c = F.col("conv_id").cast("string")
    kinds = [F.concat(F.lit("request_dump_"), c, F.lit("_214623_e95335_20260710_214753_463451")), F.concat(F.lit("request_dump_"), c, F.lit("_b")), F.concat(F.lit("sample"), c), F.concat(F.lit("x."), c)]
    name = F.concat(F.element_at(F.array(*kinds), (F.col("conv_id") % 4 + 1).cast("int")), F.lit(".json"))
    return table(spark, sf_dir, "conversations").select(name.alias("file")).distinct().select("file", dumps.session_id(F.col("file")).alias("session_id"))


# --- compression -----------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN length(text) > 6000 THEN text[:6000] || chr(10) || '[... truncated from ' || length(text) || ' chars]' ELSE text END AS content FROM documents")
def cap_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.capped("text").alias("content"))


_HISTORY = """
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS content, role = 'system' AS sys FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, sys ORDER BY turn DESC) AS back, count(*) FILTER (WHERE NOT sys) OVER (PARTITION BY conv_id) AS others FROM m),
kept AS (SELECT conv_id, CASE WHEN others > 4 AND NOT sys THEN 2 ELSE 0 END AS place, turn, role, content FROM r WHERE others <= 4 OR sys OR back <= 4
UNION ALL SELECT conv_id, 1, 0, 'system', '[Previous conversation summarized: ' || count(*) || ' messages, ~' || (sum(length(content)) + count(*) - 1) || ' chars]' FROM r WHERE others > 4 AND NOT sys AND back > 4 GROUP BY conv_id)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place, turn) - 1 AS out_idx, role, content FROM kept
"""


@query(_HISTORY)
def compress_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), "role", F.coalesce("text", F.lit("")).alias("content"))
    return compress.compress_messages(rows, ["conv_id"], turns=2)


@query(_HISTORY)
def compress_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    short = rows.select("conv_id", F.posexplode(compress.compressed_array(F.col("m"), turns=2)).alias("out_idx", "x"))
    return short.select("conv_id", F.col("out_idx").cast("long").alias("out_idx"), "x.role", "x.content")


# --- the request path ------------------------------------------------------------------------------------------

# twins normalize to the same messages, so a conversation's two requests are one class; equal conversations too
_REQ = f"""
c AS (SELECT conv_id, list({{'role': role, 'content': coalesce(text, '')}} ORDER BY turn) AS m, string_agg(role || chr(1) || coalesce(text, ''), chr(2) ORDER BY turn) AS k FROM conversations GROUP BY conv_id),
req AS (SELECT conv_id * 2 + i AS request_id, conv_id, {_MODELS}[conv_id % 4 + 1] AS model, conv_id % 7 = 0 AS streaming, CASE WHEN conv_id % 3 = 0 THEN 'messages' ELSE 'chat' END AS api,
  i, m, k, conv_id % 100 AS prompt_tokens, conv_id % 50 AS completion_tokens, conv_id % 150 AS total_tokens FROM c, unnest([0, 1]) AS t(i)),
keyed AS (SELECT *, min(request_id) OVER (PARTITION BY model, k) AS class, row_number() OVER (PARTITION BY model, k, streaming ORDER BY request_id) AS nth FROM req),
replayed AS (SELECT *, NOT streaming AND nth > 1 AS is_hit FROM keyed)
"""


@query(f"WITH {_REQ} SELECT request_id, class FROM keyed")
def request_cache_key_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests.keyed(adapters.requests(spark, sf_dir))
    return rows.select("request_id", F.min("request_id").over(W.partitionBy("key")).alias("class"))


@query(f"WITH {_REQ} SELECT request_id, is_hit FROM replayed")
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.replayed(requests.keyed(adapters.requests(spark, sf_dir))).select("request_id", "is_hit")


@query(f"WITH {_REQ} SELECT request_id, is_hit FROM replayed WHERE NOT streaming")
def cache_replay_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.replayed(_request_stream(spark, sf_dir)).select("request_id", "is_hit")


@query(f"WITH {_REQ} SELECT count(*) AS exact_entries, CAST(sum(n - 1) AS BIGINT) AS exact_repeat_hits FROM (SELECT class, count(*) AS n FROM keyed WHERE NOT streaming GROUP BY model, k, class)")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.cache_stats(requests.replayed_cache(requests.keyed(adapters.requests(spark, sf_dir))))


_UPSERT_SQL = """
WITH w AS (SELECT event_type || '/' || user_id || '/' || event_id // 2 % 5 AS key, event_type AS model, props AS response, event_id AS w_at FROM events),
old AS (SELECT key, arg_max(model, w_at) AS model, arg_max(response, w_at) AS response, 1 + count(*) AS hits FROM w WHERE w_at % 2 = 0 GROUP BY key),
new AS (SELECT key, arg_max(model, w_at) AS model, arg_max(response, w_at) AS response, 1 AS hits FROM w WHERE w_at % 2 = 1 GROUP BY key)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE key NOT IN (SELECT key FROM new)
"""


@query(_UPSERT_SQL)
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the events are in the cache, each looked up once; the other half is written into it."""
    writes = table(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", "user_id", F.floor(F.col("event_id") / 2) % 5).alias("key"), F.col("event_type").alias("model"), F.col("props").alias("response"), F.timestamp_seconds("event_id").alias("created_at"), "event_id")
    before, after = writes.where("event_id % 2 = 0").drop("event_id"), writes.where("event_id % 2 = 1").drop("event_id")
    old = requests.counted(requests.stored(before), before.select("key", F.lit(True).alias("cacheable")))
    return requests.merged(old, after).select("key", "model", "response", "hits")


_ANSWERS = "answers AS (SELECT model, k, arg_max('r' || conv_id, request_id) AS response FROM req WHERE i = 0 AND conv_id % 2 = 0 GROUP BY model, k)"


def _answers(rows: DataFrame) -> DataFrame:
    """The first request of every second conversation as writes to the cache."""
    return rows.where("request_id % 4 = 0").select("key", "model", F.concat(F.lit("r"), F.floor(F.col("request_id") / 2).cast("string")).alias("response"), F.col("ts").alias("created_at"))


@query(f"""WITH {_REQ}, {_ANSWERS}, asked AS (SELECT model, k, count(*) AS n FROM req WHERE NOT streaming GROUP BY model, k)
SELECT request_id, response, CASE WHEN response IS NOT NULL THEN 1 + coalesce(n, 0) END AS hits FROM req LEFT JOIN answers USING (model, k) LEFT JOIN asked USING (model, k)""")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request's cached response, and the hits of its entry after all lookups."""
    rows = requests.keyed(adapters.requests(spark, sf_dir))
    cache = requests.stored(_answers(rows))
    hits = requests.counted(cache, rows).select("key", "hits")
    return requests.looked_up(cache, rows).join(hits, "key", "left").select("request_id", "response", "hits")


@query(f"WITH {_REQ}, {_ANSWERS}, n AS (SELECT count(*) AS n, max(response) AS r FROM answers) SELECT 0::BIGINT AS step, 0::BIGINT AS entries, NULL::VARCHAR AS largest UNION ALL SELECT 1, n, r FROM n UNION ALL SELECT 2, 0, NULL")
def cache_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache at a path: before anything was stored, as it is read back, and after it was cleared."""
    path = fresh_path(spark, "cache")
    look = lambda step: requests.open_cache(spark, path).agg(F.count("*").alias("entries"), F.max("response").alias("largest")).select(F.lit(step).cast("long").alias("step"), "entries", "largest").collect()  # noqa: E731  one row
    seen = look(0)
    requests.save_cache(requests.stored(_answers(requests.keyed(adapters.requests(spark, sf_dir)))), path)
    seen += look(1)
    requests.clear_cache(spark, path)
    return spark.createDataFrame(seen + look(2), "step long, entries long, largest string")


@query(f"""WITH {_REQ}, sized AS (SELECT *, greatest(1, (2 + len(m) - 1 + list_sum(list_transform(m, lambda x: length(CAST(to_json({{'role': x.role, 'content': trim(x.content, {_WS}) || chr(10) || '[DATE]'}}) AS VARCHAR))))) // 4) AS before FROM replayed)
SELECT request_id, is_hit, CAST(before AS BIGINT) AS tokens_before, CAST(CASE WHEN is_hit THEN (CASE WHEN total_tokens > 0 THEN total_tokens ELSE 1 END) ELSE greatest(0, before - prompt_tokens) END AS BIGINT) AS tokens_saved FROM sized""")
def request_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.optimized(adapters.requests(spark, sf_dir)).select("request_id", "is_hit", "tokens_before", "tokens_saved")


@query(f"""WITH {_REQ}, sized AS (SELECT *, greatest(1, (2 + len(m) - 1 + list_sum(list_transform(m, lambda x: length(CAST(to_json({{'role': x.role, 'content': trim(x.content, {_WS}) || chr(10) || '[DATE]'}}) AS VARCHAR))))) // 4) AS before FROM replayed),
saved AS (SELECT is_hit, CAST(CASE WHEN is_hit THEN (CASE WHEN total_tokens > 0 THEN total_tokens ELSE 1 END) ELSE greatest(0, before - prompt_tokens) END AS BIGINT) AS t FROM sized)
SELECT count(*) AS calls, count(*) FILTER (WHERE is_hit) AS hits, CAST(sum(t) AS BIGINT) AS tokens_saved, CAST(sum(t) AS BIGINT) * 0.001::DOUBLE / 1000 AS cost_saved,
count(*) || ' calls, ' || count(*) FILTER (WHERE is_hit) || ' cache hits, ~' || {_COMMAS.format("CAST(sum(t) AS BIGINT)")} || ' tokens saved' || CASE WHEN sum(t) * 0.001 / 1000 >= 0.01 THEN ' (~$' || (CAST(sum(t) AS BIGINT) + 5000) // 1000000 || '.' || lpad(CAST((CAST(sum(t) AS BIGINT) + 5000) // 10000 % 100 AS VARCHAR), 2, '0') || ')' ELSE '' END AS line FROM saved""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.run_summary(requests.optimized(adapters.requests(spark, sf_dir)))


def _first_half(c):
    return F.substring(c, F.lit(1), F.floor(F.length(c) / 2).cast("int"))


compress.register_compressor("half", _first_half)

# the log's own layout: the first twin ends in "\n" and a date, the second in two spaces, "\r\n", a date, "\r\n"
_PROXY = f"""
WITH {_REQ}, told AS (SELECT api, completion_tokens, list_transform(m, lambda x: {{'role': x.role, 'content': x.content || CASE WHEN i = 0 THEN chr(10) || '2024-05-06' ELSE '  ' || chr(13) || chr(10) || '2025-11-12' || chr(13) || chr(10) END}}) AS m FROM req),
cut AS (SELECT *, list_transform(m, lambda x: {{'role': x.role, 'content': CASE WHEN length(x.content) > 200 THEN x.content[:length(x.content) // 2] ELSE x.content END}}) AS s FROM told),
sized AS (SELECT api, completion_tokens AS out, length(CAST(to_json(m) AS VARCHAR)) // 4 AS before, length(CAST(to_json(s) AS VARCHAR)) // 4 AS after FROM cut)
SELECT api, count(*) AS total_requests, CAST(sum(before) AS BIGINT) AS total_input_tokens_before, CAST(sum(after) AS BIGINT) AS total_input_tokens_after, CAST(sum(out) AS BIGINT) AS total_output_tokens,
round(sum((before - after) / 1e6::DOUBLE * CASE WHEN api = 'chat' THEN 2.5::DOUBLE ELSE 3.0::DOUBLE END), 6) AS estimated_cost_saved, round(1 - sum(after) / sum(before), 6) AS ratio FROM sized GROUP BY api
"""


def _ratio(s: DataFrame) -> DataFrame:
    r = accounting.ratio(F.col("total_input_tokens_before"), F.col("total_input_tokens_after"))
    return s.withColumn("ratio", F.round(r, 6)).withColumn("estimated_cost_saved", F.round("estimated_cost_saved", 6))


@query(_PROXY)
def proxy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratio(accounting.stats(adapters.requests(spark, sf_dir), "half", by=["api"]))


def _request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log as files, then as a stream of them, in order of time by file."""
    path = fresh_path(spark, "requests")
    adapters.requests(spark, sf_dir).repartitionByRange(4, "ts").write.parquet(path)
    return streams.request_log(spark, path)


@query(_PROXY)
def proxy_stats_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = accounting.stats(_request_stream(spark, sf_dir), "half", by=["api"])
    return _ratio(streams.finished(stats, "complete", "stats"))


_LATE = f"""
WITH {_REQ}, timed AS (SELECT *, 1700000000 + request_id AS sec, conv_id % 10 = 0 AND conv_id < (SELECT max(conv_id) // 2 FROM c) AS late FROM req),
mark AS (SELECT max(sec) AS high FROM timed WHERE NOT late),
told AS (SELECT sec // 60 * 60 AS start, list_transform(m, lambda x: {{'role': x.role, 'content': x.content || CASE WHEN i = 0 THEN chr(10) || '2024-05-06' ELSE '  ' || chr(13) || chr(10) || '2025-11-12' || chr(13) || chr(10) END}}) AS m, completion_tokens AS out
  FROM timed, mark WHERE NOT late OR sec // 60 * 60 + 60 > high - 30)
SELECT start, count(*) AS total_requests, CAST(sum(length(CAST(to_json(m) AS VARCHAR)) // 4) AS BIGINT) AS total_input_tokens_before, CAST(sum(out) AS BIGINT) AS total_output_tokens
FROM told, mark WHERE start + 60 <= high - 30 GROUP BY start
"""


@query(_LATE)
def stats_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by minute of event time; a tenth of the first half of the conversations comes when the watermark has passed it, and is left out.

    Only minutes that the watermark has closed are there: half a minute is allowed for.
    """
    path, log = fresh_path(spark, "requests"), adapters.requests(spark, sf_dir).withColumn("conv", F.floor(F.col("request_id") / 2))
    half = F.floor(log.agg(F.max("conv")).first()[0] / F.lit(2))
    late = (F.col("conv") % 10 == 0) & (F.col("conv") < half)
    # a folder and a run for each micro-batch: all that comes in time, an empty one in which the watermark takes effect, and
    # what is late; as many files in each as there is to write, all of them read in one micro-batch
    def come():
        for rows in (log.where(~late), log.limit(0), log.where(late), log.limit(0)):
            rows.drop("conv").write.mode("append").parquet(path)
            yield streams.request_log(spark, path, files_per_trigger=1_000_000)

    windows = streams.finished_each((streams.stats_by_window(s, "1 minute", "30 seconds") for s in come()), "append", "windows")
    return windows.select(F.unix_timestamp("start").alias("start"), "total_requests", "total_input_tokens_before", "total_output_tokens")


@query("SELECT user_id, count(*) AS total_requests, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE / 3600::DOUBLE, 6) AS hours FROM events GROUP BY user_id")
def runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours from each user's first event to the last."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total_requests"), F.min(seconds).alias("start"), F.max(seconds).alias("now"))
    return per.select("user_id", "total_requests", F.round(accounting.hours(F.col("start"), F.col("now")), 6).alias("hours"))


@query(f"""WITH {_REQ}, told AS (SELECT api, completion_tokens, list_transform(m, lambda x: {{'role': x.role, 'content': x.content || CASE WHEN i = 0 THEN chr(10) || '2024-05-06' ELSE '  ' || chr(13) || chr(10) || '2025-11-12' || chr(13) || chr(10) END}}) AS m FROM req WHERE conv_id % 5 <> 0)
SELECT count(*) AS total_requests, CAST(sum(length(CAST(to_json(m) AS VARCHAR)) // 4) AS BIGINT) AS total_input_tokens_before, CAST(sum(completion_tokens) AS BIGINT) AS total_output_tokens, api, (SELECT count(*) FROM req WHERE conv_id % 5 = 0) AS passed_on FROM told GROUP BY api""")
def proxy_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by API of raw requests, routed by their path, and how many went elsewhere."""
    log = accounting.routed(adapters.raw_requests(spark, sf_dir))
    other = log.where("api is null").agg(F.count("*").alias("passed_on"))
    per = accounting.stats(log, by=["api"]).select("total_requests", "total_input_tokens_before", "total_output_tokens", "api")
    return per.crossJoin(F.broadcast(other))  # one row


@query(f"""{_PROXY.split("SELECT api, count(*)")[0]} SELECT count(*) AS total_requests, CAST(sum(before) AS BIGINT) AS total_input_tokens_before, CAST(sum(after) AS BIGINT) AS total_input_tokens_after, CAST(sum(out) AS BIGINT) AS total_output_tokens,
round(sum((before - after) / 1e6::DOUBLE * CASE WHEN api = 'chat' THEN 2.5::DOUBLE ELSE 3.0::DOUBLE END), 4) AS estimated_cost_saved FROM sized""")
def stats_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals as they are read back from their file."""
    path = fresh_path(spark, "stats")
    accounting.save_stats(accounting.stats(adapters.requests(spark, sf_dir), "half"), path)
    return accounting.load_stats(spark, path)


# --- sources: files that are written from the conversations and read back --------------------------------------

_CONVS = "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL"
_DB_SESSION = f"SELECT CAST(conv_id AS VARCHAR) AS session_id, {_MODELS}[conv_id % {len(adapters.MODELS)} + 1] AS model, CASE WHEN conv_id % 4 = 0 THEN 0 ELSE conv_id % 50 END AS message_count, conv_id * 10 AS input_tokens, 0::BIGINT AS output_tokens, conv_id / 8::DOUBLE AS cost_usd"
_DB_COLUMNS = ["session_id", "model", "message_count", "input_tokens", "output_tokens", "cost_usd"]


@query(f"{_DB_SESSION} FROM (SELECT DISTINCT conv_id FROM ({_CONVS}))")
def database_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database.read_database(spark, adapters.session_databases(spark, sf_dir))[0].select(*_DB_COLUMNS)


@query(f"""SELECT CAST(conv_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, coalesce(text, '') AS content, CASE WHEN turn % 2 = 0 THEN 'tool' END AS tool_name,
CASE WHEN turn <> 0 THEN turn END AS token_count, CASE WHEN turn % 3 = 1 AND conv_id % 5 <> 0 THEN 'look_up' END AS called, CASE WHEN turn % 3 = 1 AND conv_id % 5 = 0 THEN 'not json' END AS raw FROM ({_CONVS}) WHERE turn % 7 <> 6""")
def database_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active messages in the order of their ids, calls parsed."""
    m = database.read_database(spark, adapters.session_databases(spark, sf_dir))[1]
    return m.select("session_id", "idx", "role", "content", "tool_name", "token_count", F.col("tool_calls")[0]["function"]["name"].alias("called"), F.col("tool_calls_raw").alias("raw"))


@query(f"{_DB_SESSION}, (SELECT count(*) FROM ({_CONVS}) AS m WHERE m.conv_id = c.conv_id AND turn % 7 <> 6) AS messages, how FROM (SELECT min(conv_id) AS conv_id, 'id' AS how FROM ({_CONVS}) UNION ALL SELECT max(conv_id), 'latest' FROM ({_CONVS})) AS c")
def database_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session by its id, as a user names it, and the session that began last."""
    path = adapters.session_databases(spark, sf_dir)
    first = table(spark, sf_dir, "conversations").agg(F.min("conv_id")).first()[0]
    out = []
    for how, found in (("id", resolve.read_session(spark, str(first), database=path)), ("latest", resolve.read_session(spark, database=path))):
        out.append(found[0].select(*_DB_COLUMNS).crossJoin(F.broadcast(found[1].agg(F.count("*").alias("messages")))).withColumn("how", F.lit(how)))  # one row each
    return out[0].unionByName(out[1])


_JSON_CHARS = r"length(regexp_replace(regexp_replace(regexp_replace({0}, '[\x{{10000}}-\x{{10FFFF}}]', repeat('u', 12), 'g'), '[^ -~\n\r\t\f\x08]', repeat('u', 6), 'g'), '[\x22\\\n\r\t\f\x08]', 'uu', 'g'))"
_DUMPED = f"""
SELECT conv_id || '_a_b' AS session_id, {_MODELS}[conv_id % {len(adapters.MODELS)} + 1] AS model, count(*) AS message_count, count(*) FILTER (WHERE role = 'assistant' AND turn % 3 = 1) AS tool_call_count,
greatest(1, CAST(sum({len(json.dumps({"role": "", "content": ""}))} - 2 + {_JSON_CHARS.format("role")} + CASE WHEN text IS NULL THEN 4 ELSE 2 + {_JSON_CHARS.format("text")} END + CASE WHEN turn % 3 = 1 THEN {len(json.dumps({"tool_calls": adapters.CALL}))} ELSE 0 END) AS BIGINT) // 4) AS input_tokens
FROM ({_CONVS}) GROUP BY conv_id
"""
_DUMP_COLUMNS = ["session_id", "model", "message_count", "tool_call_count", "input_tokens"]


@query(_DUMPED)
def dump_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dumps.read_dumps(spark, adapters.request_dumps(spark, sf_dir))[0].select(*_DUMP_COLUMNS)


@query(f"SELECT conv_id || '_a_b' AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, text AS content, CASE WHEN turn % 3 = 1 THEN 'look_up' END AS called FROM ({_CONVS})")
def dump_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = dumps.read_dumps(spark, adapters.request_dumps(spark, sf_dir))[1]
    return m.select("session_id", "idx", "role", "content", F.col("tool_calls")[0]["function"]["name"].alias("called"))


@query(f"SELECT * FROM ({_DUMPED}) ORDER BY CAST(string_split(session_id, '_')[1] AS BIGINT) % 2 DESC, CAST(string_split(session_id, '_')[1] AS BIGINT) DESC LIMIT 1")
def dump_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest dump of a folder; the index file beside it is newer still."""
    return resolve.read_session(spark, adapters.request_dumps(spark, sf_dir))[0].select(*_DUMP_COLUMNS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's ranked findings."""
    return ranked_findings(spark, sf_dir)


__all__ = ["ORACLE_SQL", "QUERIES", "Tables", "flagship"]
