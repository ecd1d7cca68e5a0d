"""From findings to a ranked report with advice."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thriftlens.functions import text
from thriftlens.operators import registry
from thriftlens.operators.tables import Tables


def ranked(found: DataFrame) -> DataFrame:
    """Findings with their rank in the session: by tokens * confidence, ties in the order they were found in."""
    order = W.partitionBy("session_id").orderBy(F.desc(F.col("tokens_wasted") * F.col("confidence")), "det_ord", "emit_ord")
    return found.withColumn("rank", F.row_number().over(order))


def run_analysis(t: Tables, detectors: Iterable[str] | None = None) -> DataFrame:
    """Ranked findings of every session, in one plan: of all detectors if t is strict, else of those that don't fail."""
    return ranked(registry.findings(t, detectors))


def dollars(cost: Column, total: Column) -> Column:
    """The known cost, else $1 per 1M tokens; null where neither is known."""
    return F.when(cost > 0, cost).when(total > 0, total / F.lit(1e6))


def percent(wasted: Column, total: Column) -> Column:
    """Whole percents that could be avoided, 99 at most; null where nothing can be said."""
    return F.when((total > 0) & (wasted > 0), F.least(F.lit(99), F.floor(wasted / total * F.lit(100)))).cast("long")


def summary(sessions: DataFrame, found: DataFrame) -> DataFrame:
    """session_id, total_tokens, cost, wasted, waste_pct of every session."""
    per = found.groupBy("session_id").agg(F.sum("tokens_wasted").alias("wasted"))
    total = F.col("input_tokens") + F.col("output_tokens")
    rows = sessions.select("session_id", total.alias("total_tokens"), "cost_usd").join(per, "session_id", "left").withColumn("wasted", F.coalesce("wasted", F.lit(0)))
    return rows.select("session_id", "total_tokens", dollars(F.col("cost_usd"), F.col("total_tokens")).alias("cost"), "wasted", percent(F.col("wasted"), F.col("total_tokens")).alias("waste_pct"))


def format_output(sessions: DataFrame, found: DataFrame, top: int = 3) -> DataFrame:
    """session_id, report: a header line and up to `top` ranked findings."""
    s = summary(sessions, found)
    cost = F.when(F.col("cost").isNotNull(), F.concat(F.lit("~$"), F.format_string("%.2f", "cost"))).otherwise("unknown")
    waste = F.when(F.col("waste_pct").isNotNull(), F.format_string(", %d%% avoidable.", "waste_pct")).when(F.col("wasted") > 0, F.format_string(", ~%,d tokens waste.", "wasted")).otherwise(". No significant waste detected.")
    header = F.concat(F.format_string("Session %s: %,d tokens, ", "session_id", "total_tokens"), cost, waste)
    line = F.concat(F.format_string("  %d. %s (%dx): ~%,d tokens — ", "rank", "pattern", "count", "tokens_wasted"), F.replace("description", F.lit("\n"), F.lit("\n      ")))
    lines = found.where(F.col("rank") <= top).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    body = F.concat(F.lit("\n\nTop wastes:\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return s.join(lines, "session_id", "left").select("session_id", F.concat(header, F.coalesce(body, F.lit(""))).alias("report"))


#: One text for each pattern; {count}, {tool_name}, {cheaper_model} and {detail} are filled in.
ADVICE = {
    "duplicate_tool_calls": "Look through earlier messages before calling a tool: {tool_name} was called with the same arguments in {count} groups of calls. Reuse a result that is already there, and say why if you must fetch it again.",
    "near_duplicate_tool_calls": "One tool was called {count} times with changing arguments. Plan what you need first, ask for it in one call where you can, and read only the lines that matter.",
    "context_bloat": "The context holds text that no longer helps. {detail} Read files in parts, don't fetch again what an earlier answer has, and suggest a new session once this one is long.",
    "model_mismatch": "{count} short questions went to an expensive model. Let {cheaper_model} answer quick look-ups and yes-or-no questions, and keep the expensive model for work that needs it.",
    "heartbeat_waste": "Run scheduled checks and status polling on {cheaper_model}. Such a check needs little reasoning; put several of them into one message, and stop when nothing changes.",
}
FALLBACK = "This session spends tokens it could save ({pattern}): {detail}"


def filled(pattern: Column, count: Column, description: Column) -> Column:
    """The advice for a finding."""
    template = F.lit(FALLBACK)
    for p, t in ADVICE.items():
        template = F.when(pattern == p, F.lit(t)).otherwise(template)
    for slot, value in (("pattern", pattern), ("count", count.cast("string")), ("tool_name", text.tool_named(description)), ("cheaper_model", text.cheaper_named(description)), ("detail", description)):
        template = F.replace(template, F.lit("{" + slot + "}"), value)
    return template


def generate_prompts(found: DataFrame, top: int = 3) -> DataFrame:
    """session_id, n, prompt: one advice for each base pattern, in rank order, `top` at most."""
    base = F.replace("pattern", F.lit("near_"), F.lit(""))
    first = found.withColumn("base", base).withColumn("k", F.row_number().over(W.partitionBy("session_id", "base").orderBy("rank"))).where("k = 1")
    numbered = first.withColumn("n", F.row_number().over(W.partitionBy("session_id").orderBy("rank"))).where(F.col("n") <= top)
    return numbered.select("session_id", "n", "pattern", filled(F.col("pattern"), F.col("count"), F.coalesce("description", F.lit(""))).alias("prompt"))


def analyze(t: Tables, detectors: Iterable[str] | None = None) -> DataFrame:
    """session_id, report, prompts: what a user reads for each session."""
    found = run_analysis(t, detectors)
    prompts = generate_prompts(found).groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "prompt"))), lambda x: x["prompt"]).alias("prompts"))
    return format_output(t.sessions, found).join(prompts, "session_id", "left")
