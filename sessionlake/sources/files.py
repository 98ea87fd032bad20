"""Sessions from log files. A file is a row and a session: nothing is shuffled, and a task reads files one by one."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_values import canonical
from ..functions.scalars import project_of_encoded_dir
from ..operators.paths import prefixes, resolve_hashes
from ..schema import SESSION
from . import formats
from .transcript import session, valid_text


#: The schema's own columns, in order.
_COLUMNS = ["session_id", "model", "git_branch", "start_time", "end_time", "project", "source", "messages", "stats", "redaction_policy"]


def entries(text: str | None) -> list[dict]:
    """The objects of JSON lines; blank and malformed lines are left out."""
    out = []
    for line in (text or "").split("\n"):
        try:
            value = json.loads(line) if line.strip() else None
        except ValueError:
            continue
        if isinstance(value, dict):
            out.append(value)
    return out


def row(found: dict) -> dict:
    """A session as a row of the schema: open values as JSON text."""
    text = lambda v: None if v is None else canonical(v)

    def message(m: dict) -> dict:
        tools = m.get("tool_uses")
        return {
            **{k: m.get(k) for k in ("role", "content", "thinking", "timestamp")},
            "content_parts": [canonical(p) for p in m["content_parts"]] if m.get("content_parts") else None,
            "tool_uses": [{"tool": t.get("tool"), "id": t.get("id"), "input": text(t.get("input")), "output": text(t.get("output")), "status": t.get("status")} for t in tools] if tools else None,
        }

    keys = ("session_id", "model", "git_branch", "start_time", "end_time", "project", "source", "redaction_policy")
    return {**{k: found.get(k) for k in keys}, "messages": [message(m) for m in found["messages"]], "stats": found.get("stats")}


def _clean(value: Any) -> Any:
    if isinstance(value, str):
        return valid_text(value)
    if isinstance(value, list):
        return [_clean(x) for x in value]
    return {valid_text(k): _clean(v) for k, v in value.items()} if isinstance(value, dict) else value


def prefixed(source: str, cwd: str | None) -> str:
    last = [p for p in re.split(r"[/\\]", cwd or "") if p]
    return f"{source}:{last[-1] if last else 'unknown'}"


def _stem(path: str) -> str:
    return re.sub(r"\.[^./]*$", "", path.rsplit("/", 1)[-1])


def _folder(path: str, up: int = 1) -> str:
    parts = path.split("/")
    return parts[-1 - up] if len(parts) > up else ""


def _meta(events: list, key: str) -> Any:
    return next((e.value for e in reversed(events) if getattr(e, "key", None) == key and e.value), None)


def claude_project(name: str) -> str:
    """The project in an encoded path: what follows ``Users`` or ``home``, the user and a common folder."""
    parts = [p for p in name.split("-") if p]
    at = next((i for i, p in enumerate(parts) if p in ("Users", "home")), None)
    if at is None:
        return "-".join(parts) or name
    rest = parts[at + 2 :]
    return "-".join(rest[1:] if rest and rest[0] in ("Documents", "Downloads", "Desktop") else rest) or "~home"


def _claude(path: str, text: str, thinking: bool) -> dict | None:
    return session(formats.claude(entries(text)), "claude", _stem(path), claude_project(_folder(path)), thinking)


def _codex(path: str, text: str, thinking: bool) -> dict | None:
    events = list(formats.codex(entries(text)))
    cwds = [e.value for e in events if getattr(e, "key", None) == "cwd" and e.value]
    if cwds and cwds[0] != cwds[-1]:
        return None  # a session is of the project in which it began; one that moved away is of none
    out = session(events, "codex", _stem(path), prefixed("codex", cwds[-1] if cwds else None), thinking)
    provider = _meta(events, "provider")
    if out and provider and not _meta(events, "model"):
        out["model"] = f"{provider}-codex"
    return out


def _gemini(path: str, text: str, thinking: bool) -> dict | None:
    if path.endswith(".jsonl"):
        document = formats.gemini_log(entries(text))
    else:
        try:
            document = json.loads(text)
        except ValueError:
            return None
    return session(formats.gemini(document), "gemini", _stem(path), f"gemini:{_folder(path, 2)}", thinking) if isinstance(document, dict) else None


def _kimi(path: str, text: str, thinking: bool) -> dict | None:
    return session(formats.kimi(entries(text)), "kimi", _folder(path), f"kimi:{_folder(path, 2)}", thinking)


def _openclaw(path: str, text: str, thinking: bool) -> dict | None:
    events = list(formats.openclaw(entries(text)))
    return session(events, "openclaw", _stem(path), prefixed("openclaw", _meta(events, "cwd")), thinking)


_FILES: dict[str, tuple[str, Callable[[str, str, bool], dict | None]]] = {
    "claude": ("*.jsonl", _claude),
    "codex": ("*.jsonl", _codex),
    "gemini": ("session-*.json*", _gemini),
    "kimi": ("context.jsonl", _kimi),
    "openclaw": ("*.jsonl", _openclaw),
}


def _texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    found = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), "value")


def read(spark: SparkSession, source: str, path: str, thinking: bool = True, known: DataFrame | None = None) -> DataFrame:
    """The sessions below a folder of logs of one of claude, codex, gemini, kimi, openclaw or custom. ``known``: folders
    (column path) that hashed names of gemini projects may stand for."""
    if source == "custom":
        return read_custom(spark, path)
    pattern, parse = _FILES[source]
    rows = _texts(spark, path, pattern)
    if source == "claude":
        rows = rows.where(~F.col("path").contains("/subagents/"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [parse(p, t, thinking) for p, t in zip(frame["path"], frame["value"])]
            yield pd.DataFrame([row(_clean(s)) for s in found if s], columns=_COLUMNS)

    out = rows.mapInPandas(run, SESSION)
    if source == "claude":
        out = out.unionByName(_subagents(spark, path, thinking))
    if source == "kimi":
        out = _kimi_projects(spark, path, out)
    if source == "gemini":
        out = gemini_projects(out, known)
    return out


def _subagents(spark: SparkSession, path: str, thinking: bool) -> DataFrame:
    """Sessions of the agents below a session: their logs merged by time, each at the largest time of its file so far.
    The id gets a suffix where the session has a log of its own."""
    rows = _texts(spark, path, "agent-*.jsonl").where(F.col("path").contains("/subagents/"))
    owner = rows.withColumn("owner", F.regexp_extract("path", r"^(.*)/subagents/[^/]*$", 1))
    roots = _texts(spark, path, "*.jsonl").where(~F.col("path").contains("/subagents/")).select(F.regexp_replace("path", r"\.jsonl$", "").alias("owner")).distinct().withColumn("has_root", F.lit(True))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        order: list[tuple] = []
        for n, (_, text) in enumerate(sorted(zip(frame["path"], frame["value"]))):
            latest = ""
            for k, e in enumerate(entries(text)):
                stamp = e.get("timestamp")
                latest = max(latest, stamp if isinstance(stamp, str) else "")
                order.append((latest, n, k, e))
        own = frame["owner"].iloc[0]
        found = session(formats.claude([e for *_, e in sorted(order, key=lambda x: x[:3])]), "claude", own.rsplit("/", 1)[-1], claude_project(own.rsplit("/", 2)[-2]), thinking)
        if found and frame["has_root"].iloc[0] == True:  # noqa: E712
            found["session_id"] = f"{found['session_id']}:subagents"
        return pd.DataFrame([row(_clean(found))] if found else [], columns=_COLUMNS)

    return owner.join(roots, "owner", "left").groupBy("owner").applyInPandas(fold, SESSION)


def gemini_projects(sessions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Projects named by the SHA-256 of a folder get the folder's name: one of ``known``, or a folder above a file that
    one of the project's sessions worked on. Others keep eight digits; names that are no hash stay."""
    digest = F.regexp_extract("project", r"^gemini:(.{64})$", 1)
    hashed = sessions.select(digest.alias("hash"), "messages").where("hash <> ''")
    uses = F.flatten(F.transform(F.filter("messages", lambda m: m["tool_uses"].isNotNull()), lambda m: m["tool_uses"]))
    given = F.explode(F.array_distinct(F.transform(uses, lambda t: F.coalesce(F.get_json_object(t["input"], "$.file_path"), F.get_json_object(t["input"], "$.path")))))
    touched = hashed.select("hash", given.alias("path")).where("path like '/%'").distinct()
    found = resolve_hashes(hashed, prefixes(touched, "path").select(F.col("prefix").alias("path")).where("path <> ''").distinct(), "hash", "path")
    if known is not None:
        found = found.select("hash", "path").unionByName(resolve_hashes(hashed, known.select("path").distinct(), "hash", "path").select("hash", "path"))
    names = found.groupBy("hash").agg(F.element_at(F.split(F.min("path"), "/"), -1).alias("folder"))
    own = sessions.withColumn("hash", digest).join(names, "hash", "left")
    short = F.concat(F.lit("gemini:"), F.coalesce("folder", F.substring("hash", 1, 8)))
    return own.withColumn("project", F.when(F.col("hash") != "", short).otherwise(F.col("project"))).select(sessions.columns)


def _kimi_projects(spark: SparkSession, path: str, sessions: DataFrame) -> DataFrame:
    """Folders named by a hash of the project's path, by the paths that the tool's settings list."""
    dirs = _texts(spark, path, "kimi.json").select(F.explode(F.from_json("value", "work_dirs array<struct<path string>>")["work_dirs"]["path"]).alias("p"))
    known = dirs.distinct().select(F.md5("p").alias("hash"), F.element_at(F.split("p", "/"), -1).alias("name"))
    own = sessions.withColumn("hash", F.substring_index("project", ":", -1)).join(known, "hash", "left")
    return own.withColumn("project", F.concat(F.lit("kimi:"), F.coalesce("name", F.substring("hash", 1, 8)))).drop("hash", "name").select(sessions.columns)


def read_custom(spark: SparkSession, path: str) -> DataFrame:
    """Sessions that are in the schema already, a JSON object a line, in a folder for each project. Lines without id,
    model or messages are left out. Lines are split freely among tasks."""
    lines = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, line in zip(frame["path"], frame["value"]):
                for e in entries(line):
                    if e.get("session_id") and e.get("model") and isinstance(e.get("messages"), list) and e["messages"]:
                        e |= {"project": f"custom:{_folder(p)}", "source": "custom", "messages": [m for m in e["messages"] if isinstance(m, dict)]}
                        stats = e.get("stats")
                        e["stats"] = {k: int(stats[k]) if isinstance(stats.get(k), (int, float)) else 0 for k in ("user_messages", "assistant_messages", "tool_uses", "input_tokens", "output_tokens")} if isinstance(stats, dict) else None
                        rows.append(row(_clean(e)))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return lines.mapInPandas(run, SESSION)


def catalog(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Projects with their number of sessions and bytes. A custom log holds a session a line, others one a file."""
    from ..operators.rollup import project_catalog

    if source == "custom":
        lines = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").text(path).where(F.trim("value") != "")
        project = F.element_at(F.split("_metadata.file_path", "/"), -2)
        return project_catalog(lines.select(F.lit(source).alias("source"), project.alias("project"), F.octet_length("value").cast("long").alias("bytes")))
    pattern = _FILES[source][0] if source in _FILES else "*.jsonl"
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    parts = F.split("path", "/")
    if source == "claude":
        # project/<session>.jsonl is a session, and so are project/<session>/subagents/agent-*.jsonl together.
        below = F.element_at(parts, -2) == "subagents"
        agent = below & F.element_at(parts, -1).startswith("agent-")
        root = ~F.col("path").contains("/subagents/")
        project = F.when(below, F.try_element_at(parts, F.lit(-4))).otherwise(F.element_at(parts, -2))
        one = F.when(below, F.try_element_at(parts, F.lit(-3))).otherwise(F.element_at(parts, -1))
        sessions = listed.where(root | agent).groupBy(project.alias("folder"), below.alias("agents"), one.alias("session")).agg(F.sum("bytes").alias("bytes"))
        return project_catalog(sessions.select(F.lit(source).alias("source"), project_of_encoded_dir(F.col("folder")).alias("project"), "bytes"))
    up = {"gemini": 3, "kimi": 3}.get(source, 2)
    found = listed.select(F.lit(source).alias("source"), F.element_at(parts, -up).alias("project"), "bytes")
    return project_catalog(found.where("project <> 'bin'") if source == "gemini" else found)



def catalogs(spark: SparkSession, stores: dict[str, str]) -> DataFrame:
    """The projects of several sources (source to path), by name, then source. Stores in SQLite count their sessions;
    their bytes are those of the texts that the sessions hold."""
    from . import sqlite
    from ..operators.rollup import project_catalog

    out = None
    for source, path in stores.items():
        if source in sqlite.READERS:
            size = F.octet_length(F.to_json("messages")).cast("long").alias("bytes")
            one = project_catalog(sqlite.READERS[source](spark, path).select("source", "project", size))
        else:
            one = catalog(spark, source, path)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no source given")
    return out.orderBy("project", "source")
