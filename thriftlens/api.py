"""The names a user needs, in one place. DataFrames in, DataFrames out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftlens.functions import text
from thriftlens.operators.registry import get_detector, list_detectors, per_session, register_detector
from thriftlens.operators.tables import Tables
from thriftlens.plans.accounting import load_stats, routed, save_stats, stats, status_line
from thriftlens.plans.analysis import analyze, format_output, generate_prompts, run_analysis, summary
from thriftlens.plans.compress import compress_messages, compressor, list_compressors, register_compressor, register_list_compressor
from thriftlens.plans.requests import cache_stats, clear_cache, looked_up, merged, open_cache, optimized, run_summary, save_cache, stored, upsert
from thriftlens.sources.resolve import read_all, read_session


def normalize_messages(messages: DataFrame, strip_volatile: bool = True) -> DataFrame:
    """messages (role, content, ...) with clean contents and canonical roles; other columns and the order stay."""
    content = text.clean(F.coalesce("content", F.lit("")), strip_volatile)
    return messages.withColumn("content", content).withColumn("role", text.canonical_role("role"))


def report(spark: SparkSession, path: str | None = None, detectors: Iterable[str] | None = None, database: str | None = None, dumps: str | None = None) -> DataFrame | None:
    """session_id, report, prompts of one session; None if there is none.

    path: a file, a folder, or the id of a session in `database`; without it, the last session of `database`, else
    the newest of the folder `dumps`.
    """
    found = read_session(spark, path, database, dumps)
    return None if found is None else analyze(Tables(*found), detectors)


__all__ = [
    "Tables", "analyze", "cache_stats", "clear_cache", "compress_messages", "compressor", "format_output", "generate_prompts", "get_detector", "list_compressors", "list_detectors", "load_stats",
    "looked_up", "merged", "normalize_messages", "open_cache", "optimized", "per_session", "read_all", "read_session", "register_compressor", "register_detector",
    "register_list_compressor", "report", "routed", "run_analysis", "run_summary", "save_cache", "save_stats", "stats", "status_line", "stored", "summary", "upsert",
]
