"""Logs larger than a task's memory: byte splits are folded one by one, and what they know is combined.

Reading a whole log as one row needs the log in memory. Here Spark splits it by bytes, at lines, and each split is walked
once, line by line. What a split adds to its session is a :class:`Span`, and spans combine associatively: facts (first or
last wins), sums, largest running totals, time bounds. Some formats hold things back until a later line (a codex message
takes the thoughts and calls before it); a *stretch* ends at a line after which nothing is held back, and folds alone. So
a split folds all its stretches but the first and the last: those lines it hands on, and a scan over the file's splits
joins the end of one to the beginning of the next (and folds what needs the folder that an earlier split named). Results find their calls by a join, in whichever split they are.

A session is then a row of facts and a table of messages; nothing but a stretch, and a line, must fit into memory.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from itertools import groupby
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.json_values import canonical
from ..functions.scalars import project_of_encoded_dir
from ..schema import DEFAULT_MODELS, STATS, TOOL_USE
from ..scratch import written
from . import formats
from .files import _clean, _folder, _stem, claude_project, entries, prefixed
from .metrics import counted
from .transcript import Event, Meta, Result, Said, Tokens


@dataclass
class Span:
    """What a stretch of a log says of its session. ``a.then(b)`` is what both say, and is associative."""

    #: By key: the value that came first of those that the first wins, the last of those that the last wins, and the
    #: first and last of all.
    facts: dict[str, list] = field(default_factory=dict)
    added: list[int] = field(default_factory=lambda: [0, 0])
    most: list[int] = field(default_factory=lambda: [0, 0])
    counts: list[int] = field(default_factory=lambda: [0, 0, 0])  # user and assistant messages, tools
    times: list[str | None] = field(default_factory=lambda: [None, None])

    def then(self, other: Span) -> Span:
        facts = {k: list(v) for k, v in self.facts.items()}
        for k, (first, last, head, tail) in other.facts.items():
            mine = facts.get(k)
            facts[k] = [first, last, head, tail] if mine is None else [first if mine[0] is None else mine[0], mine[1] if last is None else last, mine[2], tail]
        plus = lambda a, b: [x + y for x, y in zip(a, b)]
        times = [other.times[0] if self.times[0] is None else self.times[0], self.times[1] if other.times[1] is None else other.times[1]]
        return Span(facts, plus(self.added, other.added), [max(x, y) for x, y in zip(self.most, other.most)], plus(self.counts, other.counts), times)

    def fact(self, key: str) -> Any:
        """The value that a fold over all lines would hold."""
        first, last, *_ = self.facts.get(key, (None, None, None, None))
        return first if last is None else last

    def add(self, e: Event) -> None:
        """Take in the next event, in place: the same as ``then`` of a span of this event alone."""
        if isinstance(e, Meta):
            if e.value not in (None, ""):
                mine = self.facts.setdefault(e.key, [None, None, e.value, None])
                mine[3] = e.value
                if not e.first:
                    mine[1] = e.value
                elif mine[0] is None and mine[1] is None:
                    mine[0] = e.value
        elif isinstance(e, Tokens):
            if e.total:
                self.most = [max(self.most[0], e.input), max(self.most[1], e.output)]
            else:
                self.added = [self.added[0] + e.input, self.added[1] + e.output]
        elif isinstance(e, Said):
            self.counts = [self.counts[0] + (e.role == "user"), self.counts[1] + (e.role == "assistant"), self.counts[2] + len(e.tools)]
            if e.bounds and e.time is not None:
                self.times = [e.time if self.times[0] is None else self.times[0], e.time]


def _codex_closes(e: dict) -> bool:
    payload = e.get("payload") if isinstance(e.get("payload"), dict) else {}
    return e.get("type") not in ("session_meta", "turn_context", "response_item") and payload.get("type") in ("user_message", "agent_message")


def _local_images(e: dict) -> bool:
    payload = e.get("payload")
    return isinstance(payload, dict) and bool(payload.get("local_images"))


class Rule(NamedTuple):
    """A format: its events (of entries and the folder before them), and the entries after which nothing is held back
    (None: all)."""

    pattern: str
    events: Callable[[list[dict], str | None], Iterator[Event]]
    closes: Callable[[dict], bool] | None = None
    header: bool = False  # the log's first entry says whether it is one


RULES = {
    "claude": Rule("*.jsonl", lambda found, _: formats.claude(found)),
    "codex": Rule("*.jsonl", formats.codex, _codex_closes),
    # The header is the first entry of the file, wherever it lies: a span keeps it, and the scan takes its facts.
    "openclaw": Rule("*.jsonl", lambda found, _: formats.openclaw([{"type": "session"}, *found]), header=True),
}

_TOOLS = "array<struct<tool:string,id:string,input:string,output:string,status:string,call_id:string>>"
_EVENTS = f"path string, block long, k long, kind string, role string, content string, thinking string, content_parts array<string>, tools {_TOOLS}, timestamp string, call_id string, output string, status string, span string"
_KINDS = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), _TOOLS: pa.list_(pa.struct([(k, pa.string()) for k in ("tool", "id", "input", "output", "status", "call_id")]))}
_ARROW = pa.schema([(c.split(" ")[0], _KINDS[c.split(" ")[1]]) for c in _EVENTS.split(", ")])


def folded(found: list[dict], rule: Rule, thinking: bool, span: Span, cwd: str | None) -> Iterator[dict]:
    """Messages and results of a stretch, in order; ``span`` takes in the rest."""
    for e in rule.events(found, cwd):
        if isinstance(e, Result):
            yield {"kind": "result", "call_id": e.call_id, "output": canonical(_clean(e.output)) if e.output else None, "status": e.status}
        elif not isinstance(e, Said):
            span.add(e)
        elif e.text or e.parts or e.tools or (e.thinking and thinking):
            span.add(e)
            tools = [{**_clean(t.row({})), "call_id": t.call_id} for t in e.tools]
            text = lambda v: None if v is None else canonical(v)
            yield {
                "kind": "message",
                "role": e.role,
                "content": _clean(e.text) or None,
                "thinking": (_clean(e.thinking) or None) if thinking else None,
                "content_parts": [canonical(_clean(p)) for p in e.parts] or None,
                "tools": [{"tool": t["tool"], "id": t.get("id"), "input": text(t["input"]), "output": text(t.get("output")), "status": t.get("status"), "call_id": t["call_id"]} for t in tools] or None,
                "timestamp": e.time,
            }


class Walk:
    """One byte split, walked line by line: rows of its inner stretches, then its span with what it hands on."""

    def __init__(self, path: str, block: int, rule: Rule, thinking: bool) -> None:
        self.at, self.rule, self.thinking = {"path": path, "block": block}, rule, thinking
        self.head: list[dict] | None = None if rule.closes else []
        self.held: list[dict] = []
        self.span, self.opening, self.k = Span(), None, 0
        self.cwd: str | None = None
        self.waiting: list[tuple[int, list[dict]]] = []  # stretches that need the folder, before the split names one

    def line(self, text: str) -> Iterator[dict]:
        for e in entries(text):
            if self.opening is None:
                self.opening = {k: e.get(k) for k in ("type", "id", "cwd", "timestamp")} if self.rule.header else {}
            self.held.append(e)
            if self.rule.closes and not self.rule.closes(e):
                continue
            if self.head is None:
                self.head = self.held
            else:
                waits = self.rule.closes and self.cwd is None and any(map(_local_images, self.held))
                if waits:
                    self.waiting.append((self.k, self.held))
                for row in folded(self.held, self.rule, self.thinking, self.span, self.cwd):
                    if not waits:
                        yield {**self.at, "k": self.k, **row}
                    self.k += 1
            for held in self.held if self.rule.closes else ():
                payload = held.get("payload")
                self.cwd = isinstance(payload, dict) and held.get("type") in ("session_meta", "turn_context") and payload.get("cwd") or self.cwd
            self.held = []

    def end(self) -> dict:
        handed = {"opening": self.opening, "closed": self.head is not None, "head": self.head or [], "tail": self.held, "waiting": self.waiting, "span": asdict(self.span)}
        return {**self.at, "k": 0, "kind": "span", "span": json.dumps(handed)}


_FAR = 1 << 40  # before and after all that a split numbers


def joined_up(path: str, spans: list[tuple[int, str]], source: str, thinking: bool) -> Iterator[dict]:
    """The scan over a file's spans, in order: rows of the stretches that lie across splits, and the session's row."""
    rule = RULES[source]
    total, held, opening, block = Span(), [], None, 0

    def stretch(found: list[dict], first: int, own: Span) -> Iterator[dict]:
        cwd = total.facts.get("cwd", [None] * 4)[3]
        for n, row in enumerate(folded(found, rule, thinking, own, cwd)):
            yield {"path": path, "block": block, "k": first + n, **row}

    for block, text in sorted(spans):
        s = json.loads(text)
        opening = s["opening"] if opening is None else opening
        if s["closed"]:
            yield from stretch(held + s["head"], -_FAR, own := Span())
            total, held = total.then(own), []
        for first, entries_ in s["waiting"]:
            yield from stretch(entries_, first, Span())  # its split has counted it
        held += s["tail"]
        total = total.then(Span(**s["span"]))
    yield from stretch(held, _FAR, own := Span())
    total = total.then(own)
    if rule.header and (opening or {}).get("type") != "session":
        return
    if rule.header:
        head = Span()
        for e in formats.openclaw([opening]):
            head.add(e)
        total = head.then(total)
    if found := session_row(total, source, path):
        yield {"path": path, "block": 0, "k": 0, "kind": "session", "span": json.dumps(_clean(found))}


def session_row(total: Span, source: str, path: str) -> dict | None:
    """The session's facts; None without messages, and for a codex session that ended in another folder."""
    if not any(total.counts[:2]):
        return None
    cwds = total.facts.get("cwd", [None] * 4)
    if source == "codex" and cwds[2] != cwds[3]:
        return None
    model = total.fact("model")
    if source == "codex" and not model and total.facts.get("provider"):
        model = f"{total.facts['provider'][3]}-codex"
    return {
        "session_id": total.fact("session_id") or _stem(path),
        "model": model or DEFAULT_MODELS.get(source),
        "git_branch": total.fact("git_branch"),
        "start_time": total.fact("start_time") or total.times[0],
        "end_time": total.times[1] if total.times[1] is not None else total.fact("end_time"),
        "project": claude_project(_folder(path)) if source == "claude" else prefixed(source, cwds[3]),
        "source": source,
        "stats": dict(zip(("user_messages", "assistant_messages", "tool_uses", "input_tokens", "output_tokens"), [*total.counts, total.added[0] + total.most[0], total.added[1] + total.most[1]])),
    }


class Long(NamedTuple):
    sessions: DataFrame  # path, and the session's columns without its messages
    messages: DataFrame  # path, n from 0, and a message's columns


_SESSION = f"session_id string, model string, git_branch string, start_time string, end_time string, project string, source string, stats {STATS}"


def read(spark: SparkSession, source: str, path: str, thinking: bool = True, pattern: str | None = None, counts: Observation | None = None) -> Long:
    """The sessions of claude, codex or openclaw logs below a folder, of any size, as facts and messages. The same as
    :func:`files.read` gives, root logs only; a log without messages has no rows. ``pattern``: of file names, where they
    are not the format's. ``counts``: tells afterwards how many lines were read, and how many of them were blank or
    malformed. Splits are as large as ``spark.sql.files.maxPartitionBytes`` says."""
    rule = RULES[source]
    lines = spark.read.option("pathGlobFilter", pattern or rule.pattern).option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    if source == "claude":
        rows = rows.where(~F.col("path").contains("/subagents/"))
    if counts is not None:
        rows = counted(rows, counts)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Walk | None = None
        for batch in batches:
            out: list[dict] = []
            for p, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or (now.at["path"], now.at["block"]) != (p, b):
                    out += [now.end()] if now else []
                    now = Walk(p, b, rule, thinking)
                out += now.line(text)
            yield pa.RecordBatch.from_pylist(out, _ARROW)
        if now:
            yield pa.RecordBatch.from_pylist([now.end()], _ARROW)

    def scan(key: tuple, spans: pa.Table) -> pa.Table:
        found = joined_up(key[0].as_py(), list(zip(spans["block"].to_pylist(), spans["span"].to_pylist())), source, thinking)
        return pa.Table.from_pylist(list(found), _ARROW)

    # One pass over the logs; what follows reads its result.
    found = written(rows.mapInArrow(walk, _EVENTS), "long-logs")
    # A row for each split of a file: its facts, and the lines that it could not fold alone.
    more = written(found.where("kind = 'span'").select("path", "block", "span").groupBy("path").applyInArrow(scan, _EVENTS), "long-logs-scan")
    sessions = more.where("kind = 'session'").select("path", F.from_json("span", _SESSION).alias("s")).select("path", "s.*")
    every = found.where("kind <> 'span'").unionByName(more.where("kind <> 'session'"))
    return Long(sessions, _numbered(_answered(every)).join(sessions.select("path"), "path", "left_semi"))


def _answered(events: DataFrame) -> DataFrame:
    """Messages, tools with the last result of their call in the file, wherever it lies."""
    last = F.max_by(F.struct("output", "status"), F.struct("block", "k"))
    results = events.where("kind = 'result'").groupBy("path", "call_id").agg(last.alias("result"))
    return _with_results(events.where("kind = 'message'"), results, ["path", "block", "k"], "path")


def _with_results(messages: DataFrame, results: DataFrame, at: list[str], session: str) -> DataFrame:
    """Messages (known by ``at``) with tool_uses: their tools, and the result of each call in its session."""
    # Only the calls go through the join, not the messages' texts.
    calls = messages.where("tools is not null").select(*at, F.posexplode("tools").alias("pos", "t")).select(*at, "pos", "t", F.col("t.call_id").alias("call_id"))
    met = calls.join(results, [session, "call_id"], "left")
    pick = lambda c: F.when(F.col("result").isNotNull(), F.col(f"result.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    tool = F.struct("t.tool", "t.id", "t.input", pick("output"), pick("status"))
    uses = met.groupBy(*at).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", tool.alias("tool")))), lambda x: x["tool"]).cast(f"array<{TOOL_USE}>").alias("tool_uses"))
    return messages.join(uses, at, "left")


def _numbered(messages: DataFrame) -> DataFrame:
    """Messages with their number in the file: counted by split, the splits' counts summed up."""
    counts = messages.groupBy("path", "block").count()
    before = F.sum("count").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("path", "block", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("path", "block").orderBy("k")) - 1
    return messages.withColumn("within", within).join(bases, ["path", "block"]).select("path", (F.col("base") + F.col("within")).alias("n"), "role", "content", "thinking", "content_parts", "tool_uses", "timestamp")


# Agents of a session: several logs, merged by time.

_AGENT = f"{_EVENTS}, stamp string"
_AGENT_ARROW = _ARROW.append(pa.field("stamp", pa.string()))
_FACTS = {"session_id": "last", "git_branch": "last", "model": "first", "start": "first", "end": "last"}


def agent_rows(path: str, block: int, texts: Iterator[str], thinking: bool) -> Iterator[dict]:
    """A byte split of an agent's log: messages and results, each with the largest time of the split so far, and rows of
    kind ``fact`` (role: its name, content: its value), ``sum`` (span) and ``span`` (the split's largest time)."""
    at, latest, k, total = {"path": path, "block": block}, "", 0, Span()
    first: dict[str, dict] = {}
    last: dict[str, dict] = {}
    for text in texts:
        for e in entries(text):
            stamp = e.get("timestamp")
            latest = max(latest, stamp if isinstance(stamp, str) else "")
            seen = Span()
            for row in folded([e], RULES["claude"], thinking, seen, None):
                yield {**at, "k": k, "stamp": latest, **row}
                k += 1
            found = {key: values[3] for key, values in seen.facts.items()} | {"start": seen.times[0], "end": seen.times[1]}
            for key, value in found.items():
                if key in _FACTS and value is not None:
                    fact = {**at, "k": k, "stamp": latest, "kind": "fact", "role": key, "content": _clean(value) if isinstance(value, str) else json.dumps(value)}
                    first.setdefault(key, fact)
                    last[key] = fact
            k += 1
            total = total.then(Span(added=seen.added, most=seen.most, counts=seen.counts))
    yield from (first[key] if which == "first" else last[key] for key, which in _FACTS.items() if key in first)
    yield {**at, "k": k, "kind": "sum", "stamp": latest, "span": json.dumps([*total.counts, total.added[0] + total.most[0], total.added[1] + total.most[1]])}


def read_agents(spark: SparkSession, path: str, thinking: bool = True) -> Long:
    """The sessions of the agents below claude sessions, of any size: for each session's folder the logs of its agents,
    merged by the largest time of their log so far, then by file, as a heap of the logs would give them. ``path`` is the
    session's folder. Within a split the largest time so far is a running one; that of the splits before is a window
    over one row a split. A session's messages pass through one sort, which spills."""
    lines = spark.read.option("pathGlobFilter", "agent-*.jsonl").option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value").where(F.col("path").contains("/subagents/"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((p, b, t) for batch in batches for p, b, t in zip(*(c.to_pylist() for c in batch.columns)))
        for (p, b), split in groupby(texts, key=lambda x: x[:2]):
            out: list[dict] = []
            for row in agent_rows(p, b, (t for _, _, t in split), thinking):
                out.append(row)
                if len(out) == 4096:
                    yield pa.RecordBatch.from_pylist(out, _AGENT_ARROW)
                    out = []
            yield pa.RecordBatch.from_pylist(out, _AGENT_ARROW)

    found = written(rows.mapInArrow(walk, _AGENT), "agent-logs")
    splits = found.where("kind = 'sum'").select("path", "block", "stamp")
    before = F.max("stamp").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    reached = splits.select("path", "block", F.coalesce(before, F.lit("")).alias("before"))
    timed = found.join(reached, ["path", "block"]).withColumn("at", F.struct(F.greatest("stamp", "before").alias("latest"), "path", "block", "k")).withColumn("owner", F.regexp_extract("path", r"^(.*)/subagents/[^/]*$", 1))
    messages = timed.where("kind = 'message'")
    results = timed.where("kind = 'result'").groupBy("owner", "call_id").agg(F.max_by(F.struct("output", "status"), "at").alias("result"))
    with_uses = _with_results(messages, results, ["owner", "path", "block", "k"], "owner")
    n = F.row_number().over(Window.partitionBy("owner").orderBy("at")) - 1
    numbered = with_uses.select(F.col("owner").alias("path"), n.cast("long").alias("n"), "role", "content", "thinking", "content_parts", "tool_uses", "timestamp")

    sums = timed.where("kind = 'sum'").select("owner", F.from_json("span", "array<long>").alias("s"))
    stats = sums.groupBy("owner").agg(*[F.sum(F.col("s")[i]).alias(c) for i, c in enumerate(("user_messages", "assistant_messages", "tool_uses", "input_tokens", "output_tokens"))])
    facts = timed.where("kind = 'fact'")
    pick = lambda key: (F.min_by if _FACTS[key] == "first" else F.max_by)(F.when(F.col("role") == key, F.col("content")), F.when(F.col("role") == key, F.col("at"))).alias(f"f_{key}")
    known = facts.groupBy("owner").agg(*[pick(k) for k in _FACTS])
    roots = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(path).select("path").where(~F.col("path").contains("/subagents/"))
    owners = roots.select(F.regexp_replace("path", r"\.jsonl$", "").alias("owner")).distinct().withColumn("has_root", F.lit(True))
    joined = stats.where("user_messages + assistant_messages > 0").join(known, "owner", "left").join(owners, "owner", "left")
    own_id = F.coalesce("f_session_id", F.element_at(F.split("owner", "/"), -1))
    sessions = joined.select(
        F.col("owner").alias("path"),
        F.when(F.col("has_root"), F.concat(own_id, F.lit(":subagents"))).otherwise(own_id).alias("session_id"),
        F.col("f_model").alias("model"),
        F.col("f_git_branch").alias("git_branch"),
        F.col("f_start").alias("start_time"),
        F.col("f_end").alias("end_time"),
        project_of_encoded_dir(F.element_at(F.split("owner", "/"), -2)).alias("project"),
        F.lit("claude").alias("source"),
        F.struct("user_messages", "assistant_messages", "tool_uses", "input_tokens", "output_tokens").alias("stats"),
    )
    return Long(sessions, numbered)
