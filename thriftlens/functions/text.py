"""Text functions: Column in, Column out. JVM expressions, except NFC of texts that composition may change."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thriftlens.schema import DEFAULT
from thriftlens.storage import small_batches

#: What str.strip() and str.split() take for white space: Unicode's, and U+001C to U+001F.
_SPACE = r"[\s\x1C-\x1F]"
_SPACES = "".join(c for c in map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Ends of lines; "\r\n" counts twice, which adds an empty line that nobody counts.
_LINE_END = r"[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokens(c: Column | str) -> Column:
    """Four characters a token, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text(c)) / DEFAULT.chars_per_token)).cast("long")


def tokens_from_zero(c: Column | str) -> Column:
    return F.floor(F.length(text(c)) / DEFAULT.chars_per_token).cast("long")


def list_tokens(items: Column) -> Column:
    """tokens() of each string of a list, added up; an empty list has none."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.lit(1), F.floor(F.length(F.coalesce(x, F.lit(""))) / DEFAULT.chars_per_token)).cast("long"))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfc_all(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: None if xs is None else [None if x is None else unicodedata.normalize("NFC", x) for x in xs])


#: Ranges that hold every character that canonical composition can change or move, and letters beside them.
COMPOSED = """
300-387 483-487 591-74A 7EB-108D 1161-11C2 135D-135F 1714-1734 17D2-17DD 18A9 1939-193B 1A17-1C37 1CD0-1CF9 1DC0-1DFF
1F71-2001 20D0-212B 2329-232A 2ADC 2CEF-2CF1 2D7F-2DFF 302A-302F 3099-309A A66F-A6F1 A806-A82C A8C4-A9C0 AAB0-AAF6
ABED F900-FB4E FE20-FE2F 101FD 102E0 10376-1037A 10A0D-10A3F 10AE5-10AE6 10D24-10D27 10EAB-10F85 11046-11236
112E9-11374 11442-114C3 115AF-1172B 11839-1183A 11930-11943 119E0-11A99 11C3F 11D42-11D97 11F41-11F42 16AF0-16B36
16FF0-16FF1 1BC9E 1D15E-1D1C0 1D242-1D244 1E000-1E08F 1E130-1E136 1E2AE-1E2EF 1E4EC-1E4EF 1E8D0-1E94A 2F800-2FA1D
"""
_COMPOSED = "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in COMPOSED.split())


def _composable(c: Column) -> Column:
    """Whether composition may change a text; what has nothing above U+02FF, as most Latin text, is settled by the first look."""
    return c.rlike(r"[^\x00-\x{2FF}]") & c.rlike(rf"[\x{{300}}-\x{{10FFFF}}&&[{_COMPOSED}]]")


def _bounded() -> None:
    """Python gets texts in batches bounded by bytes."""
    if (spark := SparkSession.getActiveSession()) is not None:
        small_batches(spark)


def nfc(c: Column | str) -> Column:
    """Canonical composition; only texts that it may change go to Python."""
    _bounded()
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(_nfc(F.when(_composable(c), c)), c)


def line_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def trailing_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t]+\n", "\n")


def blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


#: What changes from call to call, and what stands for it.
UUID = r"(?iU)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "[UUID]"
TIMESTAMP = r"(?U)\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})\b", "[TIMESTAMP]"
DATE = r"(?U)\b\d{4}-\d{2}-\d{2}\b", "[DATE]"


def uuids(c: Column) -> Column:
    return F.regexp_replace(c, *UUID)


def timestamps(c: Column) -> Column:
    return F.regexp_replace(c, *TIMESTAMP)


def dates(c: Column) -> Column:
    return F.regexp_replace(c, *DATE)


def volatile(c: Column) -> Column:
    return dates(timestamps(uuids(c)))


def cleaned_composed(c: Column, strip_volatile: bool = True) -> Column:
    """clean() of a text that is in NFC already."""
    c = strip(blank_lines(trailing_blanks(line_ends(c))))
    return volatile(c) if strip_volatile else c


def clean(c: Column | str, strip_volatile: bool = True) -> Column:
    """The same prompt in another layout gives the same text."""
    return cleaned_composed(nfc(c), strip_volatile)


def canonical_role(c: Column | str) -> Column:
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("user"))
    return F.when(c == "developer", "system").otherwise(c)


def normalized(messages: Column, strip_volatile: bool = True) -> Column:
    """clean() and canonical_role() on array<struct<role, content>>; order and number stay."""
    _bounded()
    contents = F.transform(messages, lambda m: F.coalesce(m["content"], F.lit("")))
    odd = F.exists(contents, _composable)
    composed = F.coalesce(_nfc_all(F.when(odd, contents)), contents)
    pairs = F.arrays_zip(F.transform(messages, lambda m: m["role"]).alias("role"), composed.alias("content"))
    return F.transform(pairs, lambda p: F.struct(canonical_role(p["role"]).alias("role"), cleaned_composed(p["content"], strip_volatile).alias("content")))


def canonical_arguments(c: Column | str) -> Column:
    """Equal for equal JSON, whatever its layout and key order; other text with white space collapsed."""
    c = text(c)
    plain = F.regexp_replace(strip(c), rf"(?U){_SPACE}+", " ")
    return F.coalesce(F.to_json(F.try_parse_json(c)), plain)


def shared_lines(c: Column | str) -> Column:
    """The distinct stripped lines that are long enough to count."""
    lines = F.transform(F.split(text(c), _LINE_END), strip)
    return F.array_distinct(F.filter(lines, lambda x: F.length(x) > DEFAULT.line_length))


def capped(c: Column | str, most: int = DEFAULT.cap) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    note = F.concat(F.lit("\n[... truncated from "), F.length(c).cast("string"), F.lit(" chars]"))
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), note)).otherwise(c)


#: Message texts that look like idle checks.
IDLE = [
    r"still (running|alive|active|working)\b",
    r"\bno (changes?|updates?|news?|output)\b",
    r"\bnothing (to|new|changed|happened)\b",
    r"\bchecking (in|status|progress)\b",
    r"\bstill nothing\b",
    r"\ball (clear|good|quiet|normal)\b",
    r"\b(polling|watching)\b",
    r"\bany (updates?|changes?|news?)\?(?=\n?\z)",
    r"\A(health|status)\s*check",
]
#: Session ids of scheduled sessions.
SCHEDULED = ["cron", "scheduled?", "heartbeat", "health.?check", "monitor", "poll"]


def idle(c: Column | str) -> Column:
    return text(c).rlike("(?iU)" + "|".join(f"(?:{p})" for p in IDLE))


def scheduled(c: Column | str) -> Column:
    return text(c).rlike("(?iU)" + "|".join(SCHEDULED))


def tool_names(c: Column | str) -> Column:
    """Names of the tools that a system text defines."""
    return F.array_distinct(F.regexp_extract_all(text(c), F.lit(r'(?U)"name":\s*"(\w+)"'), F.lit(1)))


#: Tools looked for in a description, in this order.
TOOLS = ["read_file", "search_files", "terminal", "bash", "execute", "write_file", "patch", "todo", "web_search", "web_fetch"]


def tool_named(c: Column | str) -> Column:
    """The first known tool that stands as a word of its own in a description."""
    found = F.coalesce(*[F.when(F.lower(text(c)).rlike(rf"(?U)\b{t}\b"), t) for t in TOOLS])
    return F.coalesce(found, F.lit("the tool"))


#: Fixed value: model names of the cheaper tier.
CHEAP = r"(claude-haiku[\w.-]*|gpt-[\w.-]*(?:nano|mini)|deepseek-v\d(?!\d)|gemini[\w.-]*flash[\w.-]*)"


def cheaper_named(c: Column | str) -> Column:
    """A cheaper model named in a description: after the first "to", else the shortest one, else none by name."""
    c = text(c)
    after = F.regexp_extract(c, r"(?iU)\bto\s+([a-z][a-z0-9.-]*[a-z0-9])", 1)
    named = F.regexp_extract_all(c, F.lit(f"(?iU){CHEAP}"), F.lit(1))
    numbered = F.transform(named, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x")))
    return F.when((after != "") & after.rlike(f"(?iU)\\A{CHEAP}"), after).otherwise(F.coalesce(F.array_min(numbered)["x"], F.lit("a cheaper model")))


#: Parameters of a request that its response depends on.
KEY_PARAMS = ["temperature", "top_p", "frequency_penalty", "presence_penalty", "stop", "tools", "response_format"]


def cache_key(model: Column, messages: Column, params: dict[str, Column] | None = None) -> Column:
    """SHA-256 over everything that decides a response; what isn't given counts as null."""
    given = params or {}
    parts = [model.alias("model"), messages.alias("messages"), *[given.get(p, F.lit(None).cast("string")).alias(p) for p in KEY_PARAMS]]
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def thousands(c: Column) -> Column:
    return F.format_string("%,d", c)
