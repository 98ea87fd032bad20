import json
import random
from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql.types import StructType

from sessionlake.schema import SESSION
from sessionlake.sources import files, selected
from sessionlake.sources.selected import AgentLogsReader, Unit, packed


def put(path, entries):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(e) if isinstance(e, dict) else e for e in entries))


def said(text, time="T0"):
    return {"type": "user", "timestamp": time, "message": {"content": text}}


@pytest.fixture()
def claude(tmp_path):
    for p in ("app", "site", "tool"):
        for s in range(3):
            put(tmp_path / f"-home-ann-{p}" / f"s{s}.jsonl", [said(f"{p} {s} {n}", f"T{n}") for n in range(s + 1)])
    base = tmp_path / "-home-ann-app"
    put(base / "s1" / "subagents" / "agent-a.jsonl", [said("late", "T5"), said("older, but after", "T1"), "broken"])
    put(base / "s1" / "subagents" / "agent-b.jsonl", [said("first", "T0"), said("same time", "T5"), {"type": "user", "timestamp": 7, "message": {"content": "no text time"}}])
    put(base / "alone" / "subagents" / "agent-a.jsonl", [said("alone")])
    put(base / "s1" / "subagents" / "other.jsonl", [said("no agent")])
    return tmp_path


def rows(frame):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in frame.collect())


def test_the_same_sessions(spark, claude):
    assert rows(selected.logs(spark, "claude", str(claude))) == rows(files.read(spark, "claude", str(claude)))
    assert rows(selected.logs(spark, "claude", str(claude), thinking=False, tasks="2")) == rows(files.read(spark, "claude", str(claude), thinking=False))
    assert selected.logs(spark, "claude", str(claude / "none")).collect() == []




def test_only_the_chosen_projects_files_are_opened(spark, claude):
    pick = lambda *projects: selected.logs(spark, "claude", str(claude), projects)
    assert pick("tool").count() == 3 and pick("tool", "app").count() == 8 and pick().count() == 0 and pick("gone").count() == 0
    tool, app, every = pick("tool"), pick("app"), selected.logs(spark, "claude", str(claude))
    assert tool.union(app).union(every).count() == 3 + 5 + 11
    assert tool.rdd.getNumPartitions() < every.rdd.getNumPartitions()  # tasks of the files that are read
    reader = AgentLogsReader({"path": str(claude), "projects": '["tool"]'}, StructType.fromDDL(SESSION))
    names = [p for b in reader.partitions() for u in b.units for p in u.paths]
    assert len(names) == 3 and all("-home-ann-tool/" in p for p in names)


def test_other_projects_may_be_unreadable(spark, claude, monkeypatch):
    """A selection works although every file of the other projects fails when it is opened."""
    reader = AgentLogsReader({"path": str(claude), "projects": '["tool"]'}, StructType.fromDDL(SESSION))
    monkeypatch.setattr(reader, "fs", _Watched(reader.fs))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3


class _Watched:
    """A file system that lists everything and opens one project's files."""

    def __init__(self, inner):
        self.inner = inner

    def get_file_info(self, selector):
        return self.inner.get_file_info(selector)

    def open_input_stream(self, path):
        assert "-home-ann-tool/" in path
        return self.inner.open_input_stream(path)


@pytest.mark.parametrize("source", ["codex", "openclaw"])
def test_projects_named_in_the_log(spark, tmp_path, source):
    for n in range(6):
        cwd = f"/w/p{n % 3}"
        if source == "codex":
            body = [{"type": "session_meta", "payload": {"id": f"c{n}", "cwd": cwd}}, {"type": "event_msg", "payload": {"type": "agent_message", "message": "x"}}]
        else:
            body = [{"type": "session", "id": f"o{n}", "cwd": cwd}, {"type": "message", "message": {"role": "user", "content": "x"}}]
        put(tmp_path / "a" / f"{n}.jsonl", body)
    put(tmp_path / "a" / "empty.jsonl", [])
    frame = selected.logs(spark, source, str(tmp_path))
    assert rows(frame) == rows(files.read(spark, source, str(tmp_path)))
    assert sorted(r["session_id"] for r in selected.logs(spark, source, str(tmp_path), [f"{source}:p1"]).collect()) == sorted(f"{source[0]}{n}" for n in (1, 4))
    reader = AgentLogsReader({"path": str(tmp_path), "source": source}, StructType.fromDDL(SESSION))
    reader.wanted = {f"{source}:p1"}
    assert sorted(Path(u.paths[0]).name for u in reader.units()) == ["1.jsonl", "4.jsonl", "empty.jsonl"]


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300), st.integers(1, 50))
def test_the_longest_task_is_near_the_mean(sizes, tasks):
    bins = packed([Unit((f"{n:03d}",), s) for n, s in enumerate(sizes)], tasks)
    loads = [sum(u.size for u in b) for b in bins]
    assert sorted(u.paths for b in bins for u in b) == sorted((f"{n:03d}",) for n in range(len(sizes)))
    # The bound of longest processing time, with the largest unit at most the mean.
    assert not sum(loads) or max(loads) <= (4 / 3) * max(sum(loads) / len(bins), max(sizes)) * (1 + 1e-9) + max(sizes) / 3


def test_skewed_sizes():
    rng = random.Random(3)
    for _ in range(20):
        sizes = [int(1000 / rng.random()) for _ in range(400)]
        loads = [sum(u.size for u in b) for b in packed([Unit((str(n),), s) for n, s in enumerate(sizes)], 40)]
        assert max(loads) <= 1.3 * sum(loads) / len(loads)


def test_agents_merge_as_a_heap_does():
    a = [{"timestamp": t, "n": n} for n, t in enumerate(["T1", "T9", "T2", "T3"])]
    b = [{"timestamp": t, "n": 10 + n} for n, t in enumerate(["T0", 5, "T9", "T9"])]
    assert [e["n"] for e in selected.merged_entries([iter(a), iter(b)])] == [10, 11, 0, 1, 2, 3, 12, 13]
    # Lazily: of endless logs the first entries come at once.
    endless = ({"timestamp": f"T{n:09d}"} for n in range(10**9))
    assert next(selected.merged_entries([endless, iter(a)])) is not None
