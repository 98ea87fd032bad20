"""The nine log formats, each as a generator of transcript events."""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
from collections import defaultdict
from collections.abc import Iterator
from pathlib import PurePosixPath, PureWindowsPath
from typing import Any

from ..operators.redact import is_blob
from .transcript import Event, Meta, Result, Said, Tokens, Tool, count, iso, iso_seconds, joined, lst, obj


def base64_part(kind: str, media_type: str | None, data: str) -> dict:
    return {"type": kind, "source": {"type": "base64", **({"media_type": media_type} if media_type else {}), "data": data}}


def url_part(kind: str, url: str, media_type: str | None = None) -> dict:
    """A part that lies elsewhere; a data URL is taken apart."""
    m = re.match(r"data:([^;,]*);base64,", url)
    if m:
        return base64_part(kind, m[1] or media_type, url[m.end() :])
    return {"type": kind, "source": {"type": "url", **({"media_type": media_type} if media_type else {}), "url": url}}


def file_url(path: str, cwd: str | None = None) -> str:
    """The address of a local file. A relative path is one below ``cwd``, if that is absolute; paths of Windows have
    their own rules. What stays relative stays as it is."""
    windows = lambda p: PureWindowsPath(p).is_absolute()
    if not windows(path) and not path.startswith("/") and cwd:
        if windows(cwd):
            path = str(PureWindowsPath(cwd) / path)
        elif cwd.startswith("/"):
            path = posixpath.join(cwd, path.replace("\\", "/"))
    if windows(path):
        return PureWindowsPath(path).as_uri()
    return PurePosixPath(path.replace("\\", "/")).as_uri() if path.startswith("/") else path


def part_kind(media_type: str | None) -> str:
    return "image" if (media_type or "").startswith("image/") else "document"


def parsed(value: Any) -> Any:
    """A value written as JSON in a text, however often; a text that is none stays."""
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return value
    return value


# claude


def claude(entries: list[dict]) -> Iterator[Event]:
    for e in entries:
        kind, time = e.get("type"), iso(e.get("timestamp"))
        if e.get("cwd"):
            for key, name in (("gitBranch", "git_branch"), ("version", "version"), ("sessionId", "session_id")):
                yield Meta(name, e.get(key), first=False)
            yield Meta("cwd", e["cwd"], first=False)
        message = obj(e.get("message"))
        content = message.get("content")
        blocks = [b for b in content if isinstance(b, dict)] if isinstance(content, list) else []
        if kind == "user":
            for b in blocks:
                if b.get("type") == "tool_result" and b.get("tool_use_id"):
                    yield Result(b["tool_use_id"], claude_output(b, e.get("toolUseResult"), e.get("sourceToolAssistantUUID")), "error" if b.get("is_error") else "success")
            text = content if isinstance(content, str) else joined((b.get("text") for b in blocks if b.get("type") == "text"), "\n", strip=False)
            yield Said("user", time, text if text and text.strip() else None)
        elif kind == "assistant":
            said = Said("assistant", time, joined((b.get("text") for b in blocks if b.get("type") == "text"), "\n\n"), joined((b.get("thinking") for b in blocks if b.get("type") == "thinking"), "\n\n"))
            said.tools = [Tool(b.get("name"), b.get("input"), b.get("id")) for b in blocks if b.get("type") == "tool_use"]
            yield said
            if said.text or said.thinking or said.tools:
                usage = obj(message.get("usage"))
                yield Meta("model", message.get("model"))
                yield Tokens(sum(count(usage.get(k)) for k in ("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")), count(usage.get("output_tokens")))


#: Fields of a tool's result that repeat its input.
_REPEATED = ("oldString", "newString", "structuredPatch")


def pruned(value: Any) -> Any:
    """Without nulls, empty texts, lists and objects, however deep; zero and false stay."""
    if isinstance(value, dict):
        return {k: p for k, v in value.items() if (p := pruned(v)) not in (None, "", [], {}) or p is False or p == 0 and p != ""}
    if isinstance(value, list):
        return [p for v in value if (p := pruned(v)) not in (None, "", [], {}) or p is False]
    return value


def _without_repeats(value: Any, texts: str, blobs: set[str]) -> Any:
    if isinstance(value, list):
        return [_without_repeats(v, texts, blobs) for v in value]
    if not isinstance(value, dict):
        return value
    out = {}
    for k, v in value.items():
        if k in _REPEATED or k == "content" and value.get("type") == "create":
            continue
        if isinstance(v, str) and (k == "base64" and v in blobs or k in ("stdout", "content", "text") and same_text(v, texts)):
            continue
        out[k] = _without_repeats(v, texts, blobs)
    return out


def same_text(a: str, b: str) -> bool:
    """Whether one text holds the other, line numbers before arrows aside."""
    a, b = (re.sub(r"(?m)^\s*\d+→", "", x).strip() for x in (a, b))
    return bool(a and b) and (a in b or b in a)


def claude_output(block: dict, extra: Any, origin: Any = None) -> dict | None:
    """``text`` and ``raw`` of a result: texts of the block, else of the entry; raw keeps what neither text repeats."""
    content, raw = block.get("content"), []
    if isinstance(content, str):
        text = content.strip() if not is_blob(content) else ""
        raw += [content] if is_blob(content) else []
    else:
        items = content if isinstance(content, list) else [content] if content is not None else []
        text = joined((x.get("text") if isinstance(x, dict) and x.get("type") == "text" else x if isinstance(x, str) else None for x in items), "\n\n") or ""
        raw += [x for x in items if isinstance(x, dict) and x.get("type") != "text"]
    found = obj(extra)
    if not text:
        options = [found.get("stdout"), found.get("content"), found.get("text"), obj(found.get("file")).get("content"), extra]
        text = next((x.strip() for x in options if isinstance(x, str) and x.strip() and not is_blob(x)), "")
    blobs = {s["data"] for x in raw if isinstance(x, dict) and isinstance((s := obj(x.get("source"))).get("data"), str)}
    rest = pruned(_without_repeats(found, text, blobs)) if found else None
    out: dict[str, Any] = {}
    if text:
        out["text"] = text
    kept: dict[str, Any] = {}
    if raw:
        kept["content"] = raw
    if rest:
        kept["toolUseResult"] = rest
    if origin:
        kept["sourceToolAssistantUUID"] = origin
    if kept:
        out["raw"] = kept
    return out or None


# codex


def codex(entries: list[dict], cwd: str | None = None) -> Iterator[Event]:
    """Thoughts and calls wait for the next message; parts of a user's turn for its text. ``cwd``: the folder at the
    first entry, where these are not the log's first ones; local images are below it."""
    thoughts: list[str] = []
    tools: list[Tool] = []
    parts: list[dict] = []
    parts_time = time = None

    def flush(at: str | None, text: str | None = None) -> Said:
        said = Said("assistant", at, text, "\n\n".join(dict.fromkeys(thoughts)) or None, tools=list(tools))
        thoughts.clear()
        tools.clear()
        return said

    for e in entries:
        kind, payload = e.get("type"), obj(e.get("payload"))
        sub, now = payload.get("type"), iso(e.get("timestamp"))
        user = kind == "response_item" and sub == "message" and payload.get("role") == "user" or kind == "event_msg" and sub == "user_message"
        if parts and not user:
            yield Said("user", parts_time or time, parts=list(parts))
            parts.clear()
        time = now
        if kind == "session_meta":
            cwd = payload.get("cwd") or cwd
            yield Meta("session_id", payload.get("id"))
            yield Meta("cwd", payload.get("cwd"), first=False)
            yield Meta("git_branch", obj(payload.get("git")).get("branch"))
            if payload.get("model_provider"):
                yield Meta("provider", payload["model_provider"])
        elif kind == "turn_context":
            cwd = payload.get("cwd") or cwd
            yield Meta("cwd", payload.get("cwd"), first=False)
            yield Meta("model", payload.get("model"))
        elif kind == "response_item" and user:
            if not parts:
                parts_time = now
            parts += [url_part("image", c["image_url"]) for c in lst(payload.get("content")) if isinstance(c, dict) and c.get("type") == "input_image" and isinstance(c.get("image_url"), str)]
        elif sub == "function_call":
            tools.append(Tool(payload.get("name"), parsed_arguments(payload.get("arguments")), payload.get("call_id")))
        elif sub == "custom_tool_call":
            given = payload.get("input", "")
            tools.append(Tool(payload.get("name"), {"patch": given} if isinstance(given, str) else given, payload.get("call_id")))
        elif sub in ("function_call_output", "custom_tool_call_output") and payload.get("call_id"):
            yield Result(payload["call_id"], codex_output(payload), "success")
        elif sub == "reasoning":
            thoughts += [s["text"].strip() for s in lst(payload.get("summary")) if isinstance(s, dict) and isinstance(s.get("text"), str) and s["text"].strip()]
        elif sub == "agent_reasoning" and isinstance(payload.get("text"), str) and payload["text"].strip():
            thoughts.append(payload["text"].strip())
        elif sub == "token_count":
            total = obj(obj(payload.get("info")).get("total_token_usage"))
            yield Tokens(count(total.get("input_tokens")), count(total.get("output_tokens")), total=True)
        elif sub == "user_message":
            yield flush(now)
            given = [url_part("image", x) for x in lst(payload.get("images")) if isinstance(x, str)]
            given += [url_part("image", file_url(x, cwd)) for x in lst(payload.get("local_images")) if isinstance(x, str)]
            text = payload.get("message")
            yield Said("user", now, text.strip() if isinstance(text, str) else None, parts=list(parts) or given)
            parts.clear()
        elif sub == "agent_message":
            text = payload.get("message")
            yield flush(now, text.strip() if isinstance(text, str) else None)
    if parts:
        yield Said("user", parts_time or time, parts=list(parts))
    yield flush(time)


def parsed_arguments(value: Any) -> Any:
    if not isinstance(value, str):
        return value
    try:
        found = json.loads(value)
    except ValueError:
        return value
    return found if isinstance(found, dict) else value


def codex_output(payload: dict) -> dict:
    raw = payload.get("output", "")
    if payload["type"] == "custom_tool_call_output":
        found = parsed(raw)
        if not isinstance(found, dict):
            return {"output": raw} if raw else {}
        meta = obj(found.get("metadata"))
        out = {"output": str(found["output"])} if found.get("output") else {}
        return {**out, **{k: meta[k] for k in ("exit_code", "duration_seconds") if k in meta}}
    if isinstance(raw, list):
        items = [x for x in raw if isinstance(x, dict)]
        text = joined((x.get("text") for x in items), "\n\n")
        rest = [url_part("image", x["image_url"]) if isinstance(x.get("image_url"), str) else x for x in items if not isinstance(x.get("text"), str)]
        return {**({"text": text} if text else {}), **({"raw": rest} if rest else {})}
    if not isinstance(raw, str):
        return {"raw": raw}
    head, mark, tail = raw.partition("Output:\n") if "\nOutput:\n" in f"\n{raw}" else (raw, "", "")
    out: dict[str, Any] = {}
    if m := re.search(r"(?m)^Exit code: (.*)$", head):
        out["exit_code"] = int(m[1]) if re.fullmatch(r"\s*-?\d+\s*", m[1]) else m[1].strip()
    if m := re.search(r"(?m)^Wall time: (.*)$", head):
        out["wall_time"] = m[1].strip()
    if mark and tail:
        out["output"] = tail.strip()
    return out


# cursor


def cursor_headers(composer: dict) -> list[str]:
    """The bubbles of a conversation, in order."""
    rows = composer.get("fullConversationHeadersOnly") or composer.get("conversation") or []
    return [r["bubbleId"] for r in rows if isinstance(r, dict) and r.get("bubbleId")]


def tool_name(name: str) -> str:
    """A tool's own name, without the server it comes from."""
    if m := re.fullmatch(r"mcp_[^_]*_(.+)", name, re.DOTALL):
        return m[1]
    if not name.startswith("mcp-"):
        return name
    under = name.find("_", 4)
    dash = name.rfind("-", 4, under) if under > 0 else -1
    if dash > 3:
        return name[dash + 1 :]
    m = re.fullmatch(r"mcp-(.+?)-(?:user-)?\1-(.+)", name, re.DOTALL)
    return m[2] if m else name


def cursor(bubbles: list[dict]) -> Iterator[Event]:
    for b in bubbles:
        time, text = iso(b.get("createdAt")), joined([b.get("text")], "")
        yield Meta("model", joined([obj(b.get("modelInfo")).get("modelName")], ""))
        if uris := lst(b.get("workspaceUris")):
            yield Meta("cwd", str(uris[0]).removeprefix("file://"))
        said = Said("user" if b.get("type") == 1 else "assistant", time, text)
        if b.get("type") == 2:
            said.thinking = joined([obj(b.get("thinking")).get("text")], "")
            call = obj(b.get("toolFormerData"))
            if call.get("name"):
                said.tools = [cursor_tool(call)]
        if b.get("type") in (1, 2):
            yield said
        if b.get("type") not in (1, 2) or said.text or said.thinking or said.tools:
            used = obj(b.get("tokenCount"))
            yield Tokens(count(used.get("inputTokens")), count(used.get("outputTokens")))


def cursor_tool(call: dict) -> Tool:
    given = parsed(call.get("params"))
    inner = lst(obj(given).get("tools"))
    if len(inner) == 1 and isinstance(found := parsed(obj(inner[0]).get("parameters", "{}")), dict):
        given = found
    result = parsed(call.get("result"))
    output = result if isinstance(result, dict) else {"text": result if isinstance(result, str) else json.dumps(result)} if result not in (None, "") else None
    status = call.get("status", "unknown")
    status = status.get("status", "unknown") if isinstance(status, dict) else status
    return Tool(tool_name(call["name"]), obj(given), None, output, status if isinstance(status, str) else None)


# gemini


def gemini_log(entries: list[dict]) -> dict:
    """A log of upserts as a document: a message with a known id replaces the old one where it stood."""
    head: dict[str, Any] = {}
    messages: dict[Any, dict] = {}
    for n, e in enumerate(entries):
        if "$set" in e:
            head.update(obj(e["$set"]))
        elif e.get("type") in ("user", "gemini") or "content" in e:
            messages[e.get("id") or ("line", n)] = e
        else:
            head.update(e)
    return {**head, "messages": list(messages.values()) or lst(head.get("messages"))}


def gemini(document: dict) -> Iterator[Event]:
    yield Meta("session_id", document.get("sessionId"))
    yield Meta("start_time", iso(document.get("startTime")))
    yield Meta("end_time", iso(document.get("lastUpdated")))
    made: dict[str, int] = defaultdict(int)
    open_calls: dict[str, list[str]] = defaultdict(list)
    for m in lst(document.get("messages")):
        if not isinstance(m, dict):
            continue
        time = iso(m.get("timestamp"))
        if m.get("type") == "user":
            content = m.get("content")
            items = content if isinstance(content, list) else [content]
            texts, parts = [], []
            for x in items:
                if isinstance(x, str) or isinstance(x, dict) and isinstance(x.get("text"), str):
                    texts.append(x if isinstance(x, str) else x["text"])
                elif isinstance(x, dict) and (p := gemini_part(x, made, open_calls)):
                    parts.append(p)
            text = "\n".join(texts)
            yield Said("user", time, text if text.strip() or text and parts else None, parts=parts)
        elif m.get("type") == "gemini":
            yield Meta("model", m.get("model"))
            used = obj(m.get("tokens"))
            yield Tokens(count(used.get("input")) + count(used.get("cached")), count(used.get("output")))
            content = m.get("content")
            text = content if isinstance(content, str) else "\n".join(x.get("text", "") for x in lst(content) if isinstance(x, dict))
            thoughts = joined((t.get("description") for t in lst(m.get("thoughts")) if isinstance(t, dict)), "\n\n")
            yield Said("assistant", time, joined([text], ""), thoughts, tools=[gemini_tool(t) for t in lst(m.get("toolCalls")) if isinstance(t, dict)])


def gemini_part(x: dict, made: dict[str, int], open_calls: dict[str, list[str]]) -> dict | None:
    """A part other than text. Calls without id get one of their name and number; a response without id answers the
    first call of its name that is still open."""
    if "inlineData" in x:
        d = obj(x["inlineData"])
        return base64_part(part_kind(d.get("mimeType")), d.get("mimeType"), d.get("data", ""))
    if "fileData" in x:
        d = obj(x["fileData"])
        uri = str(d.get("fileUri", ""))
        return url_part(part_kind(d.get("mimeType")), uri if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", uri) else f"file://{uri}", d.get("mimeType"))
    if "functionCall" in x:
        d = obj(x["functionCall"])
        name = str(d.get("name", ""))
        made[name] += 1
        own = d.get("id") or f"fc_{name}_{made[name]}"
        open_calls[name].append(own)
        return {"type": "tool_use", "id": own, "name": name, "input": obj(d.get("args"))}
    if "functionResponse" in x:
        d = obj(x["functionResponse"])
        waiting = open_calls[str(d.get("name", ""))]
        own = d.get("id") or (waiting[0] if waiting else None)
        if own in waiting:
            waiting.remove(own)
        return {"type": "tool_result", **({"tool_use_id": own} if own else {}), "name": d.get("name"), "content": d.get("response")}
    return None


#: What is kept of each tool's arguments, with the value where an argument is missing; tools of which
#: every argument is kept as text.
_GEMINI_ARGS: dict[str, dict[str, Any]] = {
    "read_file": {"file_path": ""},
    "write_file": {"file_path": "", "content": ""},
    "replace": {"file_path": "", "old_string": "", "new_string": "", "expected_replacements": None, "instruction": None},
    "run_shell_command": {"command": ""},
    "read_many_files": {"paths": []},
    "list_directory": {"dir_path": "", "ignore": None},
    "glob": {"pattern": ""},
}
_GEMINI_TEXT_ARGS = ("search_file_content", "grep_search", "google_web_search", "web_fetch", "codebase_investigator")
_SHELL_FIELDS = {"Command": "command", "Directory": "directory", "Output": "output", "Exit Code": "exit_code"}


def gemini_tool(call: dict) -> Tool:
    name, args = call.get("name"), obj(call.get("args"))
    if name in _GEMINI_ARGS:
        given = {k: args.get(k) or d for k, d in _GEMINI_ARGS[name].items() if args.get(k) or d is not None}
    else:
        given = {k: str(v) for k, v in args.items()} if name in _GEMINI_TEXT_ARGS else args
    answer, texts, raw = None, [], []
    for x in (x for x in lst(call.get("result")) if isinstance(x, dict)):
        if "functionResponse" in x:
            answer = obj(obj(x["functionResponse"]).get("response")).get("output")
        elif isinstance(x.get("text"), str):
            texts.append(x["text"])
        elif p := gemini_part(x, defaultdict(int), defaultdict(list)):
            raw.append(p)
    if name == "read_many_files":
        output: dict[str, Any] = {"files": [f for t in texts for f in files_in(t)]}
    elif name == "run_shell_command" and isinstance(answer, str) and answer:
        output = shell_fields(answer)
    else:
        output = {"text": answer} if answer is not None else {}
    if raw:
        output["raw"] = {"content": raw}
    return Tool(name, given, None, output, call.get("status", "unknown"))


def files_in(text: str) -> list[dict]:
    """The files of a text in which ``--- path ---`` heads each."""
    pieces = re.split(r"(?m)^--- (.*) ---$", text)
    return [{"path": p.strip(), "content": c.strip()} for p, c in zip(pieces[1::2], pieces[2::2])]


def shell_fields(text: str) -> dict:
    pieces = re.split(r"(?m)^(Command|Directory|Output|Exit Code): ", text)
    out: dict[str, Any] = {_SHELL_FIELDS[k]: v.strip() for k, v in zip(pieces[1::2], pieces[2::2])}
    if re.fullmatch(r"-?\d+", out.get("exit_code", "")):
        out["exit_code"] = int(out["exit_code"])
    return out


# hermes


def texts_in(value: Any) -> list[str]:
    """The texts of a value of any shape: those under ``text``, ``content``, ``summary`` or ``thinking``."""
    if isinstance(value, str):
        found = parsed(value) if value.lstrip()[:1] in ("[", "{") else value
        return texts_in(found) if not isinstance(found, str) else [value.strip()] if value.strip() else []
    if isinstance(value, list):
        return [t for x in value for t in texts_in(x)]
    if isinstance(value, dict):
        return [t for k in ("text", "content", "summary", "thinking", "reasoning") if k in value for t in texts_in(value[k])]
    return []


_REASONING = ("reasoning", "reasoning_content", "reasoning_details", "codex_reasoning_items", "codex_message_items")


def hermes(row: dict, messages: list[dict]) -> Iterator[Event]:
    yield Meta("session_id", row.get("id"))
    yield Meta("model", row.get("model"))
    yield Meta("start_time", iso_seconds(row.get("started_at")))
    yield Meta("end_time", iso_seconds(row.get("ended_at")))
    yield Tokens(sum(count(row.get(k)) for k in ("input_tokens", "cache_read_tokens", "cache_write_tokens")), count(row.get("output_tokens")))
    for m in messages:
        time, text = iso_seconds(m.get("timestamp")), joined([m.get("content")], "")
        if m.get("role") == "tool":
            if m.get("tool_call_id"):
                yield Result(m["tool_call_id"], {"text": text} if text else None, "success")
        elif m.get("role") == "user":
            yield Said("user", time, text)
        elif m.get("role") == "assistant":
            thoughts = dict.fromkeys(t for k in _REASONING for t in texts_in(m.get(k)))
            calls = [c for c in lst(parsed(m.get("tool_calls"))) if isinstance(c, dict)]
            tools = [Tool(obj(c.get("function")).get("name"), parsed_arguments(obj(c.get("function")).get("arguments")), c.get("call_id") or c.get("id"), keep_id=True) for c in calls]
            yield Said("assistant", time, text, "\n\n".join(thoughts) or None, tools=tools)


# kimi


def path_hash(path: str) -> str:
    """The name of a project's folder."""
    return hashlib.md5(path.encode()).hexdigest()


def kimi(entries: list[dict]) -> Iterator[Event]:
    for e in entries:
        role, content = e.get("role"), e.get("content")
        if role == "user":
            yield Said("user", None, joined([content], "") if isinstance(content, str) else joined((b.get("text") for b in lst(content) if isinstance(b, dict)), "\n\n"))
        elif role == "assistant":
            blocks = [b for b in lst(content) if isinstance(b, dict)]
            text = joined([content], "") if isinstance(content, str) else joined((b.get("text") for b in blocks if b.get("type") == "text"), "\n\n")
            thoughts = joined((b.get("think") for b in blocks if b.get("type") == "think"), "\n\n")
            tools = [Tool(obj(c.get("function")).get("name"), parsed_arguments(obj(c.get("function")).get("arguments"))) for c in lst(e.get("tool_calls")) if isinstance(c, dict)]
            yield Said("assistant", None, text, thoughts, tools=tools)
        elif role == "_usage":
            yield Tokens(0, count(e.get("token_count")), total=True)


# openclaw


def openclaw(entries: list[dict]) -> Iterator[Event]:
    """The first entry is the header; without one there is no session."""
    if not entries or entries[0].get("type") != "session":
        return
    head = entries[0]
    yield Meta("session_id", head.get("id"))
    yield Meta("cwd", head.get("cwd"))
    yield Meta("start_time", iso(head.get("timestamp")))
    named = lambda provider, model: f"{provider}/{model}" if provider and model else model
    for e in entries[1:]:
        if e.get("type") == "model_change":
            yield Meta("model", named(e.get("provider"), e.get("modelId")), first=False)
        if e.get("type") != "message":
            continue
        m = obj(e.get("message"))
        time, role, content = iso(m.get("timestamp")) or iso(e.get("timestamp")), m.get("role"), m.get("content")
        blocks = [b for b in lst(content) if isinstance(b, dict)]
        texts = [b.get("text") for b in blocks if b.get("type") == "text"]
        if role == "user":
            yield Said("user", time, joined(["\n".join(t for t in texts if isinstance(t, str)) if isinstance(content, list) else content], ""))
        elif role == "assistant":
            used = obj(m.get("usage"))
            yield Meta("model", named(m.get("provider"), m.get("model")))
            yield Tokens(count(used.get("input")) + count(used.get("cacheRead")), count(used.get("output")))
            tools = [Tool(b.get("name"), b.get("arguments"), b.get("id")) for b in blocks if b.get("type") == "toolCall"]
            yield Said("assistant", time, joined(texts, "\n\n"), joined((b.get("thinking") for b in blocks if b.get("type") == "thinking"), "\n\n"), tools=tools)
        elif role == "toolResult" and m.get("toolCallId"):
            text = joined([content], "") if isinstance(content, str) else joined(texts, "\n\n")
            rest = [b for b in blocks if b.get("type") != "text"]
            yield Result(m["toolCallId"], {**({"text": text} if text else {}), **({"raw": {"content": rest}} if rest else {})}, "error" if m.get("isError") else "success")
        elif role == "bashExecution":
            code, output = m.get("exitCode"), {}
            if m.get("output"):
                output["text"] = str(m["output"]).strip()
            if code is not None:
                output["exit_code"] = code
            yield Said("assistant", time, tools=[Tool("bash", {"command": m["command"]} if m.get("command") else {}, None, output, "error" if code else "success")])


# opencode


def opencode(row: dict, messages: list[tuple[dict, list[dict]]]) -> Iterator[Event]:
    yield Meta("session_id", row.get("id"))
    yield Meta("start_time", iso(row.get("time_created")))
    yield Meta("end_time", iso(row.get("time_updated")))
    for m, parts in messages:
        data = obj(parsed(m.get("data")))
        time, role = iso(m.get("time_created")), data.get("role")
        own = [obj(parsed(p.get("data"))) for p in parts]
        files = [url_part(part_kind(p.get("mime")), p["url"], p.get("mime")) for p in own if p.get("type") == "file" and isinstance(p.get("url"), str)]
        texts = [p.get("text") for p in own if p.get("type") == "text" and not p.get("synthetic")]
        if role == "user":
            yield Said("user", time, joined(texts, "\n\n"), parts=files)
        elif role == "assistant":
            model, used = obj(data.get("model")), obj(data.get("tokens"))
            provider, name = model.get("providerID") or data.get("providerID"), model.get("modelID") or data.get("modelID")
            yield Meta("model", f"{provider}/{name}" if provider and name else name)
            cache = obj(used.get("cache"))
            yield Tokens(count(used.get("input")) + count(cache.get("read")) + count(cache.get("write")), count(used.get("output")))
            tools = []
            for p in (p for p in own if p.get("type") == "tool"):
                state = obj(p.get("state"))
                text = state.get("output") or state.get("error")
                output: dict[str, Any] = {"text": text} if text else {}
                if attached := [url_part(part_kind(a.get("mime")), a["url"], a.get("mime")) for a in lst(state.get("attachments")) if isinstance(a, dict) and isinstance(a.get("url"), str)]:
                    output["raw"] = {"content": attached}
                status = state.get("status")
                tools.append(Tool(p.get("tool"), state.get("input"), None, output, "success" if status == "completed" else status))
            yield Said("assistant", time, joined(texts, "\n\n"), joined((p.get("text") for p in own if p.get("type") == "reasoning"), "\n\n"), parts=files, tools=tools)
