import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionlake.sources import files, long_logs
from sessionlake.sources.transcript import Meta, Said, Tokens, Tool

EVENT = st.one_of(
    st.builds(Meta, st.sampled_from(["model", "cwd"]), st.sampled_from([None, "", "a", "b", "c"]), st.booleans()),
    st.builds(Tokens, st.integers(0, 9), st.integers(0, 9), st.booleans()),
    st.builds(Said, st.sampled_from(["user", "assistant"]), st.sampled_from([None, "1", "2", "3"]), st.just("x"), tools=st.lists(st.just(Tool("t")), max_size=2), bounds=st.booleans()),
)


def span(events):
    out = long_logs.Span()
    for e in events:
        out.add(e)
    return out


@given(st.lists(EVENT, max_size=12), st.integers(0, 12), st.integers(0, 12))
@settings(max_examples=300, deadline=None)
def test_spans_combine_in_any_grouping(events, i, j):
    i, j = sorted((i, j))
    a, b, c = span(events[:i]), span(events[i:j]), span(events[j:])
    whole = span(events)
    keys = {e.key for e in events if isinstance(e, Meta)}
    for found in (a.then(b).then(c), a.then(b.then(c))):
        assert [found.fact(k) for k in keys] == [whole.fact(k) for k in keys]
        assert (found.added, found.most, found.counts, found.times) == (whole.added, whole.most, whole.counts, whole.times)
        assert {k: v[2:] for k, v in found.facts.items()} == {k: v[2:] for k, v in whole.facts.items()}


def claude(rng, n):
    yield {"type": "user", "timestamp": "T0", "cwd": "/w/app", "gitBranch": "main", "sessionId": "s", "message": {"content": "begin"}}
    for i in range(n):
        if rng.random() < 0.3:
            yield {"type": "user", "timestamp": f"T{i}", "message": {"content": [{"type": "tool_result", "tool_use_id": f"t{rng.randrange(n)}", "content": f"out {i}"}]}}
        yield {"type": "assistant", "timestamp": f"T{i}", "message": {"model": f"m{i}", "content": [{"type": "text", "text": f"é {i}"}, {"type": "thinking", "thinking": "h"}, {"type": "tool_use", "id": f"t{i}", "name": "n", "input": {"i": i}}], "usage": {"input_tokens": 1, "output_tokens": 2}}}


def codex(rng, n):
    yield {"timestamp": "T", "type": "session_meta", "payload": {"id": "c", "cwd": "/w/app", "model_provider": "p"}}
    for i in range(n):
        kind = rng.randrange(8)
        at = {"timestamp": f"T{i}"}
        if kind < 2:
            yield {**at, "type": "response_item", "payload": {"type": "reasoning", "summary": [{"text": f"think {i}"}]}}
        elif kind == 2:
            yield {**at, "type": "response_item", "payload": {"type": "function_call", "name": "f", "arguments": json.dumps({"i": i}), "call_id": f"k{i}"}}
        elif kind == 3:
            yield {**at, "type": "response_item", "payload": {"type": "function_call_output", "call_id": f"k{rng.randrange(n)}", "output": f"plain {i}\nOutput:\nx"}}
        elif kind == 4:
            yield {**at, "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_image", "image_url": f"https://x/{i}"}]}}
        elif kind == 5 and i % 3 == 0:
            yield {**at, "type": "event_msg", "payload": {"type": "user_message", "message": f"see {i}", "local_images": [f"pic{i}.png"]}}
        elif kind == 5:
            yield {**at, "type": "event_msg", "payload": {"type": "user_message", "message": f"say {i}"}}
        elif kind == 6:
            yield {**at, "type": "event_msg", "payload": {"type": "agent_message", "message": f"done {i}"}}
        else:
            yield {**at, "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "output_tokens": 1}}}}


def openclaw(rng, n):
    yield {"type": "session", "id": "o", "cwd": "/w/claw", "timestamp": "T"}
    for i in range(n):
        role = rng.choice(["user", "assistant", "toolResult", "bashExecution"])
        body = {"user": {"content": f"u{i}"}, "assistant": {"model": f"m{i}", "provider": "p", "content": [{"type": "text", "text": "a"}, {"type": "toolCall", "id": f"t{i}", "name": "n", "arguments": {}}]}, "toolResult": {"toolCallId": f"t{rng.randrange(n)}", "content": f"r{i}"}, "bashExecution": {"command": "ls", "output": "o", "exitCode": i % 2}}[role]
        yield {"type": "message", "timestamp": f"T{i}", "message": {"role": role, **body}}
        if i % 17 == 5:
            yield {"type": "model_change", "provider": "q", "modelId": f"z{i}"}


def rows(frame):
    return sorted((json.dumps(r.asDict(recursive=True), sort_keys=True) for r in frame.collect()))


@pytest.mark.parametrize("source", ["claude", "codex", "openclaw"])
@pytest.mark.parametrize("size", [300, 2_000, 1 << 27])
def test_as_the_fold_over_whole_files(spark, tmp_path, source, size):
    rng = random.Random(7)
    for f, n in enumerate([0, 1, 3, 40, 90]):
        lines = [json.dumps(e, ensure_ascii=False) for e in globals()[source](rng, n)]
        lines += ["", "not json", '"text"'] if f % 2 else []
        rng.shuffle(lines) if f == 4 and source != "openclaw" else None
        path = tmp_path / "-home-ann-app" / f"log{f}.jsonl"
        path.parent.mkdir(exist_ok=True)
        path.write_text("\n".join(["", "", *lines]) + ("\n" if f % 2 else ""))
    (tmp_path / "-home-ann-app" / "bad.jsonl").write_text('{"type": "message"}\n{"type": "session"}')
    (tmp_path / "-home-ann-app" / "empty.jsonl").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        sessions, messages = long_logs.read(spark, source, str(tmp_path))
        if size == 300:
            assert spark.read.text(str(tmp_path / "-home-ann-app" / "log4.jsonl")).rdd.getNumPartitions() > 10
        grouped = {}
        for r in sorted(messages.collect(), key=lambda r: (r["path"], r["n"])):
            grouped.setdefault(r["path"], []).append(r.asDict(recursive=True))
        found = {}
        for r in sessions.collect():
            of = r.asDict(recursive=True)
            name = of.pop("path")
            own = grouped.pop(name)
            assert [m["n"] for m in own] == list(range(len(own)))
            found[name] = of | {"messages": [{k: v for k, v in m.items() if k not in ("path", "n")} for m in own]}
        assert not grouped
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    expected = [r.asDict(recursive=True) for r in files.read(spark, source, str(tmp_path)).drop("redaction_policy").collect()]
    key = lambda r: json.dumps(r, sort_keys=True)
    assert len(expected) >= 3 and sorted(found.values(), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("size", [300, 1 << 27])
def test_agents_as_the_merge_of_whole_files(spark, tmp_path, size):
    rng = random.Random(9)
    for owner, sizes, root in (("s1", [30, 45, 3], True), ("s2", [25], False), ("s3", [0, 1], False)):
        for f, n in enumerate(sizes):
            path = tmp_path / "-home-ann-app" / owner / "subagents" / f"agent-{f}.jsonl"
            path.parent.mkdir(parents=True, exist_ok=True)
            lines = []
            for i, e in enumerate(claude(rng, n)):
                # Times go back and forth, repeat between files, and some are none.
                e["timestamp"] = rng.choice([f"T{rng.randrange(40):02d}", f"T{i:02d}", 17])
                if i % 9 == 4:
                    e |= {"cwd": "/w", "gitBranch": f"b{f}-{i}", "sessionId": rng.choice([owner, f"{owner}-x"])}
                lines.append(json.dumps(e, ensure_ascii=False))
            path.write_text("\n".join(["", *lines, "broken"]))
        if root:
            (tmp_path / "-home-ann-app" / f"{owner}.jsonl").write_text(json.dumps({"type": "user", "timestamp": "T", "message": {"content": "root"}}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        sessions, messages = long_logs.read_agents(spark, str(tmp_path))
        own = {}
        for r in sorted(messages.collect(), key=lambda r: (r["path"], r["n"])):
            own.setdefault(r["path"], []).append(r.asDict(recursive=True))
        found = []
        for r in sessions.collect():
            of = r.asDict(recursive=True)
            mine = own.pop(of.pop("path"))
            assert [m["n"] for m in mine] == list(range(len(mine)))
            found.append(of | {"messages": [{k: v for k, v in m.items() if k not in ("path", "n")} for m in mine]})
        assert not own
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    key = lambda r: json.dumps(r, sort_keys=True)
    whole = [r.asDict(recursive=True) for r in files._subagents(spark, str(tmp_path), True).drop("redaction_policy").collect()]
    assert len(whole) == 3 and sorted(found, key=key) == sorted(whole, key=key)
