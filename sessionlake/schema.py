"""The session schema.

Open values (tool inputs and outputs, content parts) are JSON text: unlike VARIANT it can be grouped, joined and
compared, and unknown fields survive as they were written. ``sessionlake.functions.json_values`` works on them.
"""

from __future__ import annotations

TOOL_USE = "struct<tool:string,id:string,input:string,output:string,status:string>"
MESSAGE = f"struct<role:string,content:string,thinking:string,content_parts:array<string>,tool_uses:array<{TOOL_USE}>,timestamp:string>"
STATS = "struct<user_messages:bigint,assistant_messages:bigint,tool_uses:bigint,input_tokens:bigint,output_tokens:bigint>"
SESSION = f"session_id string, model string, git_branch string, start_time string, end_time string, project string, source string, messages array<{MESSAGE}>, stats {STATS}, redaction_policy string"

#: The nine sources, in the order in which their catalogs are joined.
SOURCES = ("claude", "codex", "cursor", "custom", "gemini", "hermes", "kimi", "opencode", "openclaw")

#: The model of a session whose log names none.
DEFAULT_MODELS = {
    "codex": "codex-unknown",
    "cursor": "cursor-unknown",
    "hermes": "hermes-unknown",
    "kimi": "kimi-k2",
    "openclaw": "openclaw-unknown",
    "opencode": "opencode-unknown",
}

#: Fields under which strings keep user names as they are, by source.
KEPT_KEYS = {"claude": ("sourceToolAssistantUUID",), "codex": ("wall_time",), "gemini": ("id", "name", "tool_use_id")}
