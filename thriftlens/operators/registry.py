"""Detectors by name: functions from Tables to findings, built in or the user's own."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thriftlens.operators import bloat, duplicates, heartbeat, mismatch
from thriftlens.operators.tables import FINDING, Tables
from thriftlens.storage import dropped, temporary, written

Detect = Callable[[Tables], DataFrame]
#: Detectors that run at the same time.
AT_ONCE = 4
_log = logging.getLogger("thriftlens")
_registry: dict[str, Detect] = {}


class DetectorError(RuntimeError):
    """Findings that were to be whole can't be."""


def register_detector(name: str, detect: Detect) -> None:
    """The last one of a name wins."""
    _registry[name] = detect


def get_detector(name: str) -> Detect | None:
    return _registry.get(name)


def list_detectors() -> list[str]:
    return sorted(_registry)


def chosen(names: Iterable[str] | None, strict: bool = False) -> list[str]:
    """Known names in the caller's order, repeats included; unknown ones are reported and left out, or an error with strict."""
    if names is None:
        return list_detectors()
    wanted = list(names)
    if unknown := sorted({n for n in wanted if n not in _registry}):
        if strict:
            raise DetectorError(f"unknown detectors: {', '.join(unknown)}")
        _log.warning("unknown detectors: %s", ", ".join(unknown))
    return [n for n in wanted if n in _registry]


def per_session(f: Callable[[dict, list[dict]], list[dict]]) -> Detect:
    """A detector from a Python function (session, its messages in order) -> findings as dicts.

    It runs in Arrow batches of whole sessions, so a session must fit one Python worker; built-in detectors
    have no such limit. Where it raises, or gives something that isn't a finding, that session has no findings of it;
    the others keep theirs. With strict tables the detector fails there.
    """

    def detect(t: Tables) -> DataFrame:
        strict = t.strict

        # one side has the session's row, the other its messages; both are grouped by the session
        def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            rows: list[dict] = []
            for session in left.to_dict("records"):
                try:
                    found = f(session, right.sort_values("idx").to_dict("records"))
                    rows += [_checked({"session_id": key[0], "emit_ord": i, "confidence": 0.8} | x) for i, x in enumerate(found or [])]
                except Exception as e:  # noqa: BLE001
                    if strict:
                        raise
                    _log.warning("a detector failed on session %s: %s", key[0], e)
                    rows = []
            return pd.DataFrame(rows, columns=FINDING)

        schema = "session_id string, emit_ord int, pattern string, tokens_wasted long, count long, description string, confidence double"
        return t.sessions.groupBy("session_id").cogroup(t.messages.groupBy("session_id")).applyInPandas(run, schema)

    return detect


def _checked(x: dict) -> dict:
    return x | {"pattern": str(x["pattern"]), "tokens_wasted": int(x["tokens_wasted"]), "count": int(x["count"]), "description": str(x["description"]), "confidence": float(x["confidence"])}


def _run(name: str, t: Tables) -> DataFrame | Exception:
    """A detector's findings as a table of their own; the error, and a warning, if it can't be planned or fails while it runs."""
    try:
        with temporary() as keep:
            return keep(written(_registry[name](t).select(*FINDING), "findings"))
    except Exception as e:  # noqa: BLE001
        _log.warning("detector %s failed: %s", name, e)
        return e


def findings(t: Tables, detectors: Iterable[str] | None = None) -> DataFrame:
    """All findings of the chosen detectors: session_id, detector, det_ord and the columns of a finding.

    Each detector runs by itself, several at a time, and one that fails is reported and left out; the others stay. If t
    is strict, there are no findings then, but a DetectorError that names all that failed. Where there are several, the
    messages' facts are made first, in one pass over the texts.
    """
    names, made = chosen(detectors, t.strict), None
    if t.table is None and sum(_registry[n] is _built_in.get(n) for n in names) > 1:
        try:
            t = t.prepared("context_bloat" in names)
            made = t.table
        except Exception as e:  # noqa: BLE001
            if t.strict:
                raise
            _log.warning("facts of messages can't be made: %s", e)
    out = None
    with ThreadPoolExecutor(max(1, min(AT_ONCE, len(names)))) as pool:
        found = list(pool.map(lambda name: _run(name, t), names))
    if made is not None:
        dropped(made)
    failed = [(name, x) for name, x in zip(names, found) if isinstance(x, Exception)]
    if failed and t.strict:
        for rows in found:
            if not isinstance(rows, Exception):
                dropped(rows)
        raise DetectorError("; ".join(f"detector {name} failed: {e}" for name, e in failed)) from failed[0][1]
    for order, (name, rows) in enumerate(zip(names, found)):
        if not isinstance(rows, Exception):
            rows = rows.withColumn("detector", F.lit(name)).withColumn("det_ord", F.lit(order))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        schema = "session_id string, emit_ord int, pattern string, tokens_wasted long, count long, description string, confidence double, detector string, det_ord int"
        out = t.messages.sparkSession.createDataFrame([], schema)
    return out


_built_in: dict[str, Detect] = {"duplicate_tool_calls": duplicates.detect, "context_bloat": bloat.detect, "model_mismatch": mismatch.detect, "heartbeat_waste": heartbeat.detect}
for _name, _detect in _built_in.items():
    register_detector(_name, _detect)
