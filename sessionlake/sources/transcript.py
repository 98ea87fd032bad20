"""From a log's entries to a session: every provider turns its entries into a few kinds of events, and one fold
assembles the session from them. Results find their calls by id whichever comes first; the last result of an id wins.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from ..schema import DEFAULT_MODELS


@dataclass
class Tool:
    name: str | None
    input: Any = None
    call_id: str | None = None
    output: dict | None = None
    status: str | None = None
    keep_id: bool = False

    def row(self, results: dict[str, tuple[dict | None, str | None]]) -> dict:
        output, status = results.get(self.call_id, (self.output, self.status)) if self.call_id else (self.output, self.status)
        out: dict[str, Any] = {"tool": self.name, "input": as_object(self.input)}
        if output:
            out["output"] = output
        if status is not None:
            out["status"] = status
        if self.keep_id and self.call_id:
            out["id"] = self.call_id
        return out


@dataclass
class Said:
    """A message. One without content, thinking, parts or tools is none, but its tokens may count."""

    role: str
    time: str | None
    text: str | None = None
    thinking: str | None = None
    parts: list[dict] = field(default_factory=list)
    tools: list[Tool] = field(default_factory=list)
    #: Whether the message moves the session's time bounds.
    bounds: bool = True


@dataclass
class Result:
    call_id: str
    output: dict | None
    status: str | None


@dataclass
class Meta:
    """A fact about the session. ``first``: kept if there is none yet; else the last one wins. Blank values are none."""

    key: str
    value: Any
    first: bool = True


@dataclass
class Tokens:
    """Counts to add, or with ``total`` running totals, of which the largest counts."""

    input: int = 0
    output: int = 0
    total: bool = False


Event = Said | Result | Meta | Tokens


def session(events: Iterable[Event], source: str, session_id: str | None = None, project: str | None = None, thinking: bool = True) -> dict | None:
    """The session that the events tell of; None without messages."""
    facts: dict[str, Any] = {}
    results: dict[str, tuple[dict | None, str | None]] = {}
    said: list[Said] = []
    added, most = [0, 0], [0, 0]
    for e in events:
        if isinstance(e, Meta):
            if e.value not in (None, "") and not (e.first and facts.get(e.key) is not None):
                facts[e.key] = e.value
        elif isinstance(e, Result):
            results[e.call_id] = (e.output, e.status)
        elif isinstance(e, Tokens):
            if e.total:
                most = [max(most[0], e.input), max(most[1], e.output)]
            else:
                added = [added[0] + e.input, added[1] + e.output]
        elif e.text or e.parts or e.tools or (e.thinking and thinking):
            said.append(e)
    if not said:
        return None
    messages = []
    for m in said:
        row: dict[str, Any] = {"role": m.role}
        if m.text:
            row["content"] = m.text
        if m.thinking and thinking:
            row["thinking"] = m.thinking
        if m.parts:
            row["content_parts"] = m.parts
        if m.tools:
            row["tool_uses"] = [t.row(results) for t in m.tools]
        messages.append({**row, "timestamp": m.time})
    times = [m.time for m in said if m.bounds and m.time is not None]
    model = facts.get("model") or DEFAULT_MODELS.get(source)
    return {
        "session_id": facts.get("session_id") or session_id,
        "model": model,
        "git_branch": facts.get("git_branch"),
        "start_time": facts.get("start_time") or (times[0] if times else None),
        "end_time": times[-1] if times else facts.get("end_time"),
        "project": project or facts.get("project"),
        "source": source,
        "messages": messages,
        "stats": {
            "user_messages": sum(m.role == "user" for m in said),
            "assistant_messages": sum(m.role == "assistant" for m in said),
            "tool_uses": sum(len(m.tools) for m in said),
            "input_tokens": added[0] + most[0],
            "output_tokens": added[1] + most[1],
        },
    }


def as_object(value: Any) -> dict:
    """Inputs are objects: None is an empty one, anything else stands under ``raw``."""
    if isinstance(value, dict):
        return value
    return {} if value in (None, "") else {"raw": value if isinstance(value, str) else str(value)}


def iso(value: Any) -> str | None:
    """Texts as they are, numbers as epoch milliseconds, anything else none."""
    if isinstance(value, str):
        return value
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    return dt.datetime.fromtimestamp(value / 1000, dt.timezone.utc).isoformat()


def iso_seconds(value: Any) -> str | None:
    """As :func:`iso`, but numbers up to ten billion are seconds."""
    if isinstance(value, (int, float)) and not isinstance(value, bool) and abs(value) <= 1e10:
        return iso(value * 1000)
    return iso(value)


def count(value: Any) -> int:
    """A counter; what is no number counts zero."""
    return int(value) if isinstance(value, (int, float)) else 0


def obj(value: Any) -> dict:
    return value if isinstance(value, dict) else {}


def lst(value: Any) -> list:
    return value if isinstance(value, list) else []


def joined(texts: Iterable[Any], by: str, strip: bool = True) -> str | None:
    """The texts that are not blank, joined."""
    kept = [t.strip() if strip else t for t in texts if isinstance(t, str) and t.strip()]
    return by.join(kept) or None


def valid_text(text: str) -> str:
    """Lone surrogates, which UTF-8 cannot hold, as escapes."""
    if text.isascii():
        return text
    return "".join(f"\\x{ord(c) - 0xDC00:02X}" if 0xDC80 <= ord(c) <= 0xDCFF else f"\\u{ord(c):04X}" if 0xD800 <= ord(c) <= 0xDFFF else c for c in text)
