r"""Chat formatting with a grammar round trip.

A conversation is written turn by turn as

    ### role: text</turn>\n

and read back by a deterministic parser. Control strings are `###` followed by a space, and `</turn>`. Inside
texts a control string is escaped with a backslash, and the k backslashes before it become 2k: so an odd run of
backslashes before a control string means that it is text, an even run that it is control. Each turn is first
written as it is and parsed; only where the parser doesn't give back the source is it escaped, and parsed
again, until it does. In a role, backslash, colon and line break are escaped the same way.

The parser takes text in chunks and holds one turn at most, so a conversation of any length is read in
constant memory. Rendering and checking are per turn, without a shuffle; turns are then brought together by
conversation, sorted, for digests that depend on their order.

Defined results: turns in order of (turn, role, text), nulls first. Null text and null role are empty. A null
conv_id is a conversation of its own. Repeated rows are repeated turns. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, mapped

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>"
_CONTROL = re.compile(r"(\\*)(### |</turn>)")
_ROLE = re.compile(r"[\\:\n]")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1][: len(m[1]) // 2] + m[2] if len(m[1]) % 2 else m[0], text)


class Parser:
    """feed() takes chunks of formatted text and gives (role, text) of each whole turn."""

    def __init__(self) -> None:
        self.held = ""

    def feed(self, chunk: str) -> Iterator[tuple[str, str]]:
        self.held += chunk
        while self.held:
            turn = self._turn()
            if turn is None:
                return
            role, text, end = turn
            self.held = self.held[end:]
            yield role, text

    def done(self) -> bool:
        return not self.held

    def _turn(self) -> tuple[str, str, int] | None:
        s = self.held
        if not s.startswith(OPEN):
            if len(s) >= len(OPEN) or not OPEN.startswith(s):
                raise ValueError("a turn must begin with its mark")
            return None
        at, role = len(OPEN), []
        while True:
            if at >= len(s):
                return None
            if s[at] == "\\":
                role.append(s[at + 1 : at + 2])
                at += 2
            elif s.startswith(BETWEEN, at):
                break
            else:
                role.append(s[at])
                at += 1
        at += len(BETWEEN)
        for m in _CONTROL.finditer(s, at):
            if len(m[1]) % 2:
                continue
            if m[2] != CLOSE:
                raise ValueError("a turn begins inside another")
            if len(s) <= m.end():
                return None
            if s[m.end()] != "\n":
                raise ValueError("a turn must end its line")
            body = s[at : m.start(2)]
            text = unescape(body[: len(body) - len(m[1])]) + m[1][: len(m[1]) // 2]
            return "".join(role), text, m.end() + 1
        return None


def parse(formatted: str) -> list[tuple[str, str]]:
    p = Parser()
    turns = list(p.feed(formatted))
    if not p.done():
        raise ValueError("the last turn is not closed")
    return turns


def _line(role: str, text: str) -> str:
    return f"{OPEN}{role}{BETWEEN}{text}{CLOSE}\n"


def _reads_as(formatted: str, role: str, text: str) -> bool:
    try:
        return parse(formatted) == [(role, text)]
    except ValueError:
        return False


def render(role: str, text: str) -> str:
    """One formatted turn; what conflicts with the grammar is escaped until the parser gives the source back."""
    for r, t in ((role, text), (role, escape(text) + _tail(text)), (_ROLE.sub(lambda m: "\\" + m[0], role), escape(text) + _tail(text))):
        line = _line(r, t)
        if _reads_as(line, role, text):
            return line
    raise ValueError("a turn can't be written so that it reads back")


def _tail(text: str) -> str:
    """Backslashes that end a text stand before the closing mark, so they are doubled."""
    return "\\" * (len(text) - len(text.rstrip("\\")))


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, segment, mask_begin, mask_end: each turn as it is written.

    The loss mask covers an assistant's text (still escaped) in the segment, in code points; else it is empty.
    A conversation's text is its segments in order of (turn, role, text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for role, text in zip(column(b, "role").to_pylist(), column(b, "text").to_pylist()):
                line = render(role, text)
                end = len(line) - len(CLOSE) - 1
                for o, x in zip(out, (line, _text_at(line) if role == "assistant" else end, end)):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("conv_id", "turn", "role", "text")), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["conv_id", "turn", "role", "text", "segment", "mask_begin", "mask_end"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return mapped(rows, run, "conv_id long, turn long, role string, text string, segment string, mask_begin long, mask_end long")


def _text_at(line: str) -> int:
    at = len(OPEN)
    while not line.startswith(BETWEEN, at):
        at += 2 if line[at] == "\\" else 1
    return at + len(BETWEEN)


def digests(segments: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted text: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    sorted_rows = segments.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "segment", "mask_begin", "mask_end")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state = None

        def close() -> None:
            if state:
                if not state[1].done():
                    raise ValueError("the last turn is not closed")
                out.append((state[0], state[2], state[3].hexdigest(), state[4], state[5].hexdigest(), state[6]))

        for b in batches:
            for conv, segment, begin, end in zip(*(column(b, c).to_pylist() for c in ("conv_id", "segment", "mask_begin", "mask_end"))):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, Parser(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in state[1].feed(segment):
                    state[2] += 1
                    state[3].update(f"{role}\n{text}\n".encode())
                loss = unescape_body(segment[begin:end])
                state[4] += len(loss)
                state[5].update(loss.encode())
                state[6] += len(segment)
            if len(out) > 2000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], _SCHEMA)
                out = []
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], _SCHEMA)

    return mapped(sorted_rows, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def unescape_body(body: str) -> str:
    """A text as it stands between the colon and the closing mark."""
    if not body:
        return body
    ((_, text),) = parse(_line("", body))
    return text
