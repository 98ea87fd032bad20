import hashlib
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from sessionlake.plans import engine
from sessionlake.sinks import jsonl
from sessionlake.sinks.card import card
from sessionlake.sinks.yaml_text import write_yaml
from sessionlake.sources import files, formats, sqlite
from sessionlake.sources.transcript import iso, iso_seconds, valid_text

T0, T1 = "2026-01-01T00:00:00Z", "2026-01-01T00:01:00Z"


def put(path, entries):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in entries))


def records(frame):
    return sorted((json.loads(r["line"]) for r in jsonl.lines(frame).collect()), key=lambda r: (r["source"], r["session_id"]))


CLAUDE = [
    "",
    "not json",
    {"type": "user", "timestamp": T0, "cwd": "/x", "gitBranch": "main", "sessionId": "s1", "message": {"content": "hello"}},
    {"type": "user", "timestamp": T0, "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "result first", "is_error": True}]}},
    {"type": "assistant", "timestamp": 1767225660000, "message": {"model": "claude-x", "content": [{"type": "thinking", "thinking": " hm "}, {"type": "text", "text": "a"}, {"type": "text", "text": " b "}, {"type": "tool_use", "id": "t1", "name": "bash", "input": {"c": 1}}, {"type": "tool_use", "id": "t2", "name": "read", "input": "x"}], "usage": {"input_tokens": 3, "cache_read_input_tokens": 4, "output_tokens": 5}}},
    {"type": "assistant", "timestamp": T1, "message": {"model": "other", "content": [{"type": "text", "text": "  "}], "usage": {"input_tokens": 99}}},
    {"type": "user", "timestamp": T1, "message": {"content": "  "}},
]


def test_claude(spark, tmp_path):
    base = tmp_path / "projects" / "-Users-ann-Documents-app"
    put(base / "s1.jsonl", CLAUDE)
    put(base / "empty.jsonl", [])
    put(base / "s1" / "subagents" / "agent-1.jsonl", [{"type": "assistant", "timestamp": T1, "message": {"model": "m", "content": [{"type": "text", "text": "late"}]}}])
    put(base / "s1" / "subagents" / "agent-2.jsonl", [{"type": "user", "timestamp": T0, "cwd": "/x", "sessionId": "s1", "message": {"content": "early"}}])
    put(base / "alone" / "subagents" / "agent-1.jsonl", [{"type": "user", "timestamp": T0, "message": {"content": "alone"}}])
    found = records(files.read(spark, "claude", str(tmp_path / "projects")))
    assert [r["session_id"] for r in found] == ["alone", "s1", "s1:subagents"]
    s = found[1]
    assert (s["project"], s["model"], s["git_branch"], s["start_time"], s["source"]) == ("app", "claude-x", "main", T0, "claude")
    assert s["stats"] == {"user_messages": 1, "assistant_messages": 1, "tool_uses": 2, "input_tokens": 7, "output_tokens": 5}
    assert s["messages"][0] == {"role": "user", "content": "hello", "timestamp": T0}
    m = s["messages"][1]
    assert (m["content"], m["thinking"]) == ("a\n\nb", "hm")
    assert m["tool_uses"] == [{"tool": "bash", "input": {"c": 1}, "output": {"text": "result first"}, "status": "error"}, {"tool": "read", "input": {"raw": "x"}}]
    assert [x["content"] for x in found[2]["messages"]] == ["early", "late"]
    assert "thinking" not in records(files.read(spark, "claude", str(tmp_path / "projects"), thinking=False))[1]["messages"][1]


def test_claude_results():
    out = formats.claude_output({"content": "1→line\n2→two"}, {"stdout": "line\ntwo", "oldString": "x", "type": "create", "content": "y", "n": 0, "e": {}, "keep": 1})
    assert out == {"text": "1→line\n2→two", "raw": {"toolUseResult": {"type": "create", "n": 0, "keep": 1}}}
    image = {"type": "image", "source": {"type": "base64", "data": "QUJD"}}
    out = formats.claude_output({"content": [image]}, {"file": {"base64": "QUJD", "size": 3}})
    assert out["raw"] == {"content": [image], "toolUseResult": {"file": {"size": 3}}}
    assert formats.claude_output({"content": ""}, {"stdout": " done "})["text"] == "done"
    assert formats.claude_output({"content": "A" * 5000}, None) == {"raw": {"content": ["A" * 5000]}}


def test_codex(spark, tmp_path):
    entries = [
        {"timestamp": T0, "type": "session_meta", "payload": {"id": "c1", "cwd": "/w/app", "model_provider": "openai", "git": {"branch": "dev"}}},
        {"timestamp": T0, "type": "event_msg", "payload": {"type": "user_message", "message": " hi ", "images": ["data:image/png;base64,QUJD"]}},
        {"timestamp": T0, "type": "response_item", "payload": {"type": "reasoning", "summary": [{"text": "think"}]}},
        {"timestamp": T0, "type": "event_msg", "payload": {"type": "agent_reasoning", "text": "think"}},
        {"timestamp": T0, "type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": '{"cmd": "ls"}', "call_id": "k"}},
        {"timestamp": T0, "type": "response_item", "payload": {"type": "function_call_output", "call_id": "k", "output": "Exit code: 0\nWall time: 1.5 s\nOutput:\na\nb\n"}},
        {"timestamp": T1, "type": "event_msg", "payload": {"type": "agent_message", "message": "done"}},
        {"timestamp": T1, "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 50, "output_tokens": 9}}}},
        {"timestamp": T1, "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 40, "output_tokens": 10}}}},
        {"timestamp": T1, "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_image", "image_url": "https://x/y.png"}]}},
        {"timestamp": T1, "type": "response_item", "payload": {"type": "custom_tool_call", "name": "apply", "input": "*** patch", "call_id": "p"}},
    ]
    put(tmp_path / "sessions" / "2026" / "a.jsonl", entries)
    put(tmp_path / "sessions" / "moved.jsonl", [{"type": "session_meta", "payload": {"cwd": "/a"}}, {"type": "turn_context", "payload": {"cwd": "/b"}}, {"type": "event_msg", "payload": {"type": "agent_message", "message": "x"}}])
    (s,) = records(files.read(spark, "codex", str(tmp_path)))
    assert (s["session_id"], s["model"], s["git_branch"], s["project"]) == ("c1", "openai-codex", "dev", "codex:app")
    assert (s["stats"]["input_tokens"], s["stats"]["output_tokens"]) == (50, 10)
    a, b, c, d = s["messages"]
    assert a["content"] == "hi" and a["content_parts"] == [{"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": "QUJD"}}]
    assert b == {"role": "assistant", "content": "done", "thinking": "think", "tool_uses": [{"tool": "shell", "input": {"cmd": "ls"}, "output": {"exit_code": 0, "wall_time": "1.5 s", "output": "a\nb"}, "status": "success"}], "timestamp": T1}
    assert c["content_parts"][0]["source"] == {"type": "url", "url": "https://x/y.png"} and "content" not in c
    assert d["tool_uses"] == [{"tool": "apply", "input": {"patch": "*** patch"}}]
    assert formats.codex_output({"type": "custom_tool_call_output", "output": '{"output": "o", "metadata": {"exit_code": 2, "duration_seconds": 0.1}}'}) == {"output": "o", "exit_code": 2, "duration_seconds": 0.1}


def test_gemini(spark, tmp_path):
    call = {"name": "run_shell_command", "args": {"command": "ls", "x": 1}, "status": "success", "result": [{"functionResponse": {"response": {"output": "Command: ls\nDirectory: /\nOutput: a\nb\nExit Code: 0"}}}]}
    many = {"name": "read_many_files", "args": {"paths": ["a"]}, "result": [{"text": "--- a/b.txt ---\n\nbody\n--- c ---\nmore"}]}
    document = {"sessionId": "g1", "startTime": T0, "lastUpdated": T1, "messages": [
        {"type": "user", "timestamp": T0, "content": [{"text": " keep "}, {"inlineData": {"mimeType": "image/png", "data": "QUJD"}}, {"functionCall": {"name": "f", "args": {}}}, {"functionResponse": {"name": "f", "response": {"r": 1}}}]},
        {"type": "gemini", "timestamp": T1, "content": "ok", "model": "g", "tokens": {"input": 1, "cached": 2, "output": 3}, "thoughts": [{"description": "t"}], "toolCalls": [call, many]},
    ]}
    put(tmp_path / "proj" / "chats" / "session-1.json", [document])
    put(tmp_path / "proj" / "chats" / "session-2.jsonl", [{"sessionId": "g2", "startTime": T0}, {"id": "m1", "type": "user", "content": "old"}, {"id": "m2", "type": "gemini", "content": "x"}, {"id": "m1", "type": "user", "content": "new"}, {"$set": {"lastUpdated": T1}}])
    one, two = records(files.read(spark, "gemini", str(tmp_path)))
    assert (one["project"], one["start_time"], one["stats"]["input_tokens"]) == ("gemini:proj", T0, 3)
    user, bot = one["messages"]
    assert user["content"] == " keep " and [p["type"] for p in user["content_parts"]] == ["image", "tool_use", "tool_result"]
    assert user["content_parts"][2]["tool_use_id"] == user["content_parts"][1]["id"] == "fc_f_1"
    assert bot["tool_uses"][0] == {"tool": "run_shell_command", "input": {"command": "ls"}, "output": {"command": "ls", "directory": "/", "output": "a\nb", "exit_code": 0}, "status": "success"}
    assert bot["tool_uses"][1]["output"] == {"files": [{"path": "a/b.txt", "content": "body"}, {"path": "c", "content": "more"}]}
    assert [m["content"] for m in two["messages"]] == ["new", "x"]


def test_kimi_and_openclaw_and_custom(spark, tmp_path):
    key = hashlib.md5(b"/w/app").hexdigest()
    put(tmp_path / "kimi" / "kimi.json", [{"work_dirs": [{"path": "/w/app"}]}])
    body = [{"role": "user", "content": " q "}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "think", "think": "t"}], "tool_calls": [{"function": {"name": "f", "arguments": '{"x":1}'}}]}, {"role": "_usage", "token_count": 7}, {"role": "_usage", "token_count": 5}]
    put(tmp_path / "kimi" / "sessions" / key / "s1" / "context.jsonl", body)
    put(tmp_path / "kimi" / "sessions" / ("f" * 32) / "s2" / "context.jsonl", body)
    a, b = records(files.read(spark, "kimi", str(tmp_path / "kimi")))
    assert (a["project"], b["project"], a["model"], a["stats"]["output_tokens"]) == ("kimi:app", "kimi:ffffffff", "kimi-k2", 7)
    put(tmp_path / "claw" / "agents" / "x" / "sessions" / "o.jsonl", [
        {"type": "session", "id": "o1", "cwd": "/w/claw", "timestamp": T0},
        {"type": "message", "timestamp": T0, "message": {"role": "toolResult", "toolCallId": "k", "content": [{"type": "text", "text": "r"}], "isError": True}},
        {"type": "message", "timestamp": T0, "message": {"role": "assistant", "model": "m", "provider": "p", "usage": {"input": 1, "cacheRead": 2, "output": 3}, "content": [{"type": "toolCall", "id": "k", "name": "n", "arguments": {}}]}},
        {"type": "model_change", "provider": "q", "modelId": "z"},
        {"type": "message", "timestamp": T1, "message": {"role": "bashExecution", "command": "ls", "output": " o ", "exitCode": 1}},
    ])
    put(tmp_path / "claw" / "agents" / "x" / "sessions" / "bad.jsonl", [{"type": "message"}])
    (c,) = records(files.read(spark, "openclaw", str(tmp_path / "claw")))
    assert (c["session_id"], c["model"], c["project"], c["end_time"]) == ("o1", "q/z", "openclaw:claw", T1)
    assert c["messages"][0]["tool_uses"] == [{"tool": "n", "input": {}, "output": {"text": "r"}, "status": "error"}]
    assert c["messages"][1]["tool_uses"] == [{"tool": "bash", "input": {"command": "ls"}, "output": {"text": "o", "exit_code": 1}, "status": "error"}]
    put(tmp_path / "custom" / "mine" / "a.jsonl", [{"session_id": "1", "model": "m", "messages": [{"role": "user", "content": "x"}], "source": "other"}, {"session_id": "2", "model": "m", "messages": []}, {"session_id": "3", "messages": [{}]}, "broken"])
    (d,) = records(files.read(spark, "custom", str(tmp_path / "custom")))
    assert (d["project"], d["source"]) == ("custom:mine", "custom")
    catalog = files.catalog(spark, "custom", str(tmp_path / "custom")).collect()
    assert [(r["project"], r["session_count"]) for r in catalog] == [("mine", 4)]


@pytest.fixture()
def stores(tmp_path):
    c = sqlite3.connect(tmp_path / "cursor.db")
    c.execute("create table cursorDiskKV (key text primary key, value text)")
    bubbles = {"b1": {"type": 1, "text": " q ", "createdAt": 1767225600000, "workspaceUris": ["file:///w/app"]}, "b2": {"type": 2, "modelInfo": {"modelName": "gpt"}, "thinking": {"text": "t"}, "tokenCount": {"inputTokens": 2, "outputTokens": 3}, "toolFormerData": {"name": "mcp_srv_do_it", "params": json.dumps({"tools": [{"parameters": '{"a": 1}'}]}), "result": '"\\"deep\\""', "status": {"status": "ok"}}}, "b3": {"type": 2, "text": "", "tokenCount": {"inputTokens": 9}}}
    rows = [("composerData:one", json.dumps({"fullConversationHeadersOnly": [{"bubbleId": b} for b in ("b1", "b2", "b3", "gone")]})), ("composerData:short", json.dumps({"conversation": [{"bubbleId": "b1"}]}))]
    rows += [(f"bubbleId:one:{k}", json.dumps(v)) for k, v in bubbles.items()] + [(f"other:{i}", "x") for i in range(50)]
    c.executemany("insert into cursorDiskKV values (?, ?)", rows)
    c.commit()
    h = sqlite3.connect(tmp_path / "hermes.db")
    h.execute("create table sessions (id text, source text, model text, started_at real, ended_at real, message_count int, input_tokens int, output_tokens int, cache_read_tokens int, cache_write_tokens int)")
    h.execute("create table messages (id integer primary key, session_id text, role text, content text, tool_call_id text, tool_calls text, timestamp real, reasoning text, reasoning_content text, reasoning_details text)")
    h.execute("insert into sessions values ('h1', 'cli', null, 1767225600.0, null, 3, 1, 2, 3, 4), ('h0', 'cli', 'm', 1, 1, 0, 0, 0, 0, 0)")
    calls = json.dumps([{"id": "i", "call_id": "k", "function": {"name": "f", "arguments": '{"a":1}'}}])
    h.executemany("insert into messages values (?, ?, ?, ?, ?, ?, ?, ?, ?, ?)", [(1, "h1", "tool", "early", "k", None, 1767225601.0, None, None, None), (2, "h1", "user", "hi", None, None, 1767225600.0, None, None, None), (3, "h1", "assistant", None, None, calls, 1767225602.0, "why", '[{"text": "why"}, {"text": "more"}]', None)])
    h.commit()
    o = sqlite3.connect(tmp_path / "opencode.db")
    o.execute("create table session (id text, directory text, time_created int, time_updated int)")
    o.execute("create table message (id text, session_id text, time_created int, data text)")
    o.execute("create table part (id text, message_id text, time_created int, data text)")
    o.execute("insert into session values ('s', '/w/open', 1767225600000, 1767225660000)")
    o.executemany("insert into message values (?, 's', ?, ?)", [("m2", 1767225601000, json.dumps({"role": "assistant", "model": {"providerID": "p", "modelID": "m"}, "tokens": {"input": 1, "output": 2, "cache": {"read": 3, "write": 4}}})), ("m1", 1767225600000, json.dumps({"role": "user"}))])
    o.executemany("insert into part values (?, ?, ?, ?)", [("p1", "m1", 1, json.dumps({"type": "text", "text": "q"})), ("p0", "m1", 0, json.dumps({"type": "text", "text": "auto", "synthetic": True})), ("p3", "m2", 2, json.dumps({"type": "text", "text": "b"})), ("p2", "m2", 1, json.dumps({"type": "text", "text": "a"})), ("p4", "m2", 3, json.dumps({"type": "tool", "tool": "t", "state": {"status": "completed", "input": {}, "output": "o"}}))])
    o.commit()
    return {k: str(tmp_path / f"{k}.db") for k in ("cursor", "hermes", "opencode")}


def test_sqlite_stores(spark, stores):
    cursor, hermes, opencode = records(engine.read(spark, stores))
    assert (cursor["session_id"], cursor["model"], cursor["project"], cursor["start_time"]) == ("one", "gpt", "cursor:app", "2026-01-01T00:00:00+00:00")
    assert cursor["messages"][1]["tool_uses"] == [{"tool": "do_it", "input": {"a": 1}, "output": {"text": "deep"}, "status": "ok"}]
    assert (cursor["stats"]["input_tokens"], len(cursor["messages"])) == (2, 2)
    assert (hermes["model"], hermes["project"], hermes["stats"]["input_tokens"]) == ("hermes-unknown", "hermes:cli", 8)
    assert [m["role"] for m in hermes["messages"]] == ["user", "assistant"] and hermes["messages"][1]["thinking"] == "why\n\nmore"
    assert hermes["messages"][1]["tool_uses"] == [{"tool": "f", "input": {"a": 1}, "output": {"text": "early"}, "status": "success", "id": "k"}]
    assert (opencode["model"], opencode["project"], opencode["stats"]["input_tokens"]) == ("p/m", "opencode:open", 8)
    assert [m.get("content") for m in opencode["messages"]] == ["q", "a\n\nb"]
    assert opencode["messages"][1]["tool_uses"][0]["status"] == "success"
    for source, path in stores.items():
        assert sqlite.sizes(spark, source, path).where("bytes > 0").count() == 1


def test_ranges_read_every_row_once(spark, stores):
    whole = sqlite.table(spark, stores["cursor"], "cursorDiskKV", ["key", "missing"], rows=7)
    assert whole.rdd.getNumPartitions() > 5
    assert whole.select("key").distinct().count() == whole.count() == 55
    assert whole.where("missing is not null").count() == 0


def test_export_review_merge_publish_diff(spark, tmp_path, stores):
    put(tmp_path / "p" / "-home-ann-app" / "s1.jsonl", CLAUDE)
    sessions = engine.read(spark, {**stores, "claude": str(tmp_path / "p")})
    lines = engine.export(sessions, username="annette", excluded=("hermes:cli",)).cache()
    assert sorted(r["source"] for r in lines.collect()) == ["claude", "cursor", "opencode"]
    assert all(len(json.loads(r["line"])["redaction_policy"]) == 16 for r in lines.collect())
    found = engine.review(lines.withColumn("n", F.crc32("line")), "Hello", prior=10)
    assert (found.sessions, found.name_matches, found.blocks) == (3, 1, ["full_name", "session_shrink"])
    jsonl.write(lines, "line", ["source"], str(tmp_path / "local"), one_file=True)
    (tmp_path / "local" / "extra.txt").write_text("broken line\n")
    stats = engine.publish(spark, str(tmp_path / "none"), str(tmp_path / "local"), str(tmp_path / "v1"))
    assert stats == {"added": 3, "updated": 0, "carried_forward": 0, "unchanged": 0, "total": 3, "written": True}
    text = sorted(spark.read.text(str(tmp_path / "v1")).toPandas()["value"])
    assert "broken line" in text and len(text) == 4
    assert not engine.publish(spark, str(tmp_path / "v1"), str(tmp_path / "local"), str(tmp_path / "v2"))["written"]
    changed = [json.loads(t) for t in text if t != "broken line"]
    changed[0]["messages"][0]["originalFile"] = "x"
    changed[1]["messages"][0]["content"] = "two\nlines"
    put(tmp_path / "new" / "a.jsonl", changed[:2])
    put(tmp_path / "old" / "a.jsonl", [t for t in text if t != "broken line"])
    events, counts = engine.diff(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    kinds = sorted((r["event"], r["patch"] is not None) for r in events.collect())
    assert ("removed", False) in kinds and ("modified", True) in kinds
    assert counts.first()["removed"] == 1
    write_yaml(lines, "line", ["source"], str(tmp_path / "yaml"))
    assert spark.read.text(str(tmp_path / "yaml")).where("value = '---'").count() == 3
    flat = sessions.select("model", "project", "stats.input_tokens", "stats.output_tokens")
    assert "| gpt | 1 |" in card(flat, "mine")
    with pytest.raises(Exception):
        engine.merged(spark, str(tmp_path / "v1"), str(tmp_path / "none"))


def test_times_and_text():
    assert iso(1706000000000) == "2024-01-23T08:53:20+00:00" and iso("x") == "x" and iso(None) is iso(True) is None
    assert iso_seconds(1706000000) == iso_seconds(1706000000000) == "2024-01-23T08:53:20+00:00"
    assert valid_text("a\udc80b\ud800") == "a\\x80b\\uD800"


@pytest.mark.parametrize("name,expected", [("mcp_srv_do_it", "do_it"), ("mcp-srv-srv-do-it", "do-it"), ("mcp-srv-user-srv-do", "do"), ("plain", "plain"), ("mcp_x", "mcp_x"), ("mcp-a-b-do_it", "do_it")])
def test_tool_names(name, expected):
    assert formats.tool_name(name) == expected


def test_local_images_of_codex():
    url = formats.file_url
    assert url("/a/b c.png") == "file:///a/b%20c.png" and url("x/y.png", "/w/app") == "file:///w/app/x/y.png"
    assert url("x\\y.png", "C:\\w") == "file:///C:/w/x/y.png" and url("C:\\a\\b.png", "/w") == "file:///C:/a/b.png"
    assert url("x.png") == "x.png" and url("x.png", "rel") == "x.png"
    events = list(formats.codex([{"type": "session_meta", "payload": {"cwd": "/w"}}, {"type": "event_msg", "payload": {"type": "user_message", "message": "m", "images": ["https://x/y"], "local_images": ["a.png"]}}]))
    assert [p["source"]["url"] for e in events if getattr(e, "role", "") == "user" for p in e.parts] == ["https://x/y", "file:///w/a.png"]


def test_catalogs_count_what_is_read(spark, tmp_path):
    base = tmp_path / "claude" / "-Users-ann-Documents-app"
    line = [{"type": "user", "timestamp": T0, "message": {"content": "x"}}]
    for name in ("s1.jsonl", "s2.jsonl", "s1/subagents/agent-1.jsonl", "s1/subagents/agent-2.jsonl", "alone/subagents/agent-1.jsonl"):
        put(base / name, line)
    put(base / "s1" / "subagents" / "notes.jsonl", line)
    put(tmp_path / "claude" / "-home-bob-b" / "s.jsonl", line)
    put(tmp_path / "custom" / "app" / "a.jsonl", [{"session_id": str(n), "model": "m", "messages": [{"role": "user", "content": "x"}]} for n in range(2)])
    found = files.catalogs(spark, {"custom": str(tmp_path / "custom"), "claude": str(tmp_path / "claude")}).collect()
    assert [(r["project"], r["source"], r["session_count"]) for r in found] == [("app", "claude", 4), ("app", "custom", 2), ("b", "claude", 1)]
    read = files.read(spark, "claude", str(tmp_path / "claude")).groupBy("project").count().collect()
    assert {r["project"]: r["count"] for r in read} == {"app": 4, "b": 1}
    assert found[0]["total_size_bytes"] == 5 * (base / "s1.jsonl").stat().st_size
    with pytest.raises(ValueError):
        files.catalogs(spark, {})


def test_hashed_gemini_projects(spark, tmp_path):
    sha = lambda p: hashlib.sha256(p.encode()).hexdigest()
    use = lambda p, key="file_path": {"name": "read_file", "args": {key: p}, "result": []}
    document = lambda *calls: [{"sessionId": "g", "messages": [{"type": "gemini", "content": "x", "toolCalls": list(calls)}]}]
    put(tmp_path / sha("/home/ann/app") / "chats" / "session-1.json", document(use("/home/ann/app/src/a.py"), use("relative/x")))
    put(tmp_path / sha("/home/ann/app") / "chats" / "session-2.json", document())
    put(tmp_path / sha("/home/ann/site") / "chats" / "session-1.json", document())
    put(tmp_path / sha("/elsewhere") / "chats" / "session-1.json", document(use("/home/ann/app/b.py")))
    put(tmp_path / "named" / "chats" / "session-1.json", document())
    count = lambda df: {r["project"]: r["count"] for r in df.groupBy("project").count().collect()}
    short = {p: f"gemini:{sha(p)[:8]}" for p in ("/home/ann/site", "/elsewhere")}
    assert count(files.read(spark, "gemini", str(tmp_path))) == {"gemini:app": 2, "gemini:named": 1, short["/home/ann/site"]: 1, short["/elsewhere"]: 1}
    known = spark.createDataFrame([("/home/ann/site",), ("/home/ann/other",)], "path string")
    assert count(files.read(spark, "gemini", str(tmp_path), known=known)) == {"gemini:app": 2, "gemini:named": 1, "gemini:site": 1, short["/elsewhere"]: 1}


def test_selected_projects_and_malformed_lines(spark, tmp_path):
    for p in ("app", "site"):
        put(tmp_path / "claude" / f"-home-ann-{p}" / "s.jsonl", [{"type": "user", "timestamp": T0, "message": {"content": p}}])
    found = engine.read(spark, {"claude": str(tmp_path / "claude")}, projects=["site"]).collect()
    assert [(r["project"], r["messages"][0]["content"]) for r in found] == [("site", "site")]
    put(tmp_path / "old" / "a.jsonl", [{"session_id": "1", "messages": []}])
    put(tmp_path / "new" / "a.jsonl", [{"session_id": "1", "messages": []}, "not json", "[1]"])
    with pytest.raises(ValueError, match="not a JSON object"):
        engine.diff(spark, str(tmp_path / "old"), str(tmp_path / "new"))


def test_breakdowns_of_older_metadata(spark):
    from sessionlake.functions.scalars import model_key
    from sessionlake.operators import rollup

    old = spark.createDataFrame([("v/Model_1.0", 3), ("model-1-0", 2), ("Model-1-0", None), ("other", None)], "name string, sessions int")
    found = {r["model"]: tuple(r)[1:] for r in rollup.from_legacy(old, model_key(F.col("name")), "model").collect()}
    assert found["Model-1-0"] == (3, 0, 0) and found["model-1-0"] == (2, 0, 0) and found["other"] == (0, 0, 0)
