"""Table schemas and the thresholds of the analysis."""

from __future__ import annotations

from dataclasses import dataclass

CALLS = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
SESSIONS = "session_id string, model string, message_count long, tool_call_count long, input_tokens long, output_tokens long, cost_usd double, started_at string, source string"
MESSAGES = f"session_id string, idx long, role string, content string, tool_name string, tool_call_id string, token_count long, tool_calls {CALLS}, tool_calls_raw string"
FINDINGS = "session_id string, detector string, emit_ord int, pattern string, tokens_wasted long, count long, description string, confidence double"
REQUESTS = (
    "request_id long, ts timestamp, api string, model string, streaming boolean, messages array<struct<role:string,content:string>>, "
    "temperature double, top_p double, frequency_penalty double, presence_penalty double, stop string, tools string, response_format string, "
    "prompt_tokens long, completion_tokens long, total_tokens long"
)
RESPONSES = "key string, model string, response string, created_at timestamp, hits long"


@dataclass(frozen=True)
class Config:
    """Fixed values that results depend on."""

    chars_per_token: int = 4
    stale_overlap: int = 200  # characters that two tool responses share
    line_length: int = 20  # shorter lines don't count as shared
    stale_pairs: int = 2
    oversized: int = 5000  # characters of a tool response
    unused_tool_tokens: int = 500
    unused_tools_from: int = 5  # tools defined
    noise: float = 0.25
    noise_gate: float = 0.5
    long_session: int = 30  # messages
    short_prompt: int = 500
    short_answer: int = 300
    expensive: float = 1.0  # $ per 1M input tokens
    near_calls: int = 3
    near_share: float = 0.3
    near_names: int = 3
    default_response: int = 100  # tokens
    idle_messages: int = 2
    idle_share: float = 0.5
    cap: int = 6000
    turns: int = 10
    compress_from: int = 200
    top: int = 3


DEFAULT = Config()
