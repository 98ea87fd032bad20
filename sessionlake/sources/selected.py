"""Logs of chosen projects: a data source that opens no other project's files.

The projects are an option of the source, not a filter that Spark pushes down: Spark 4.1 keeps what it pushed into a Python
source with the loaded table, so that two filters on one DataFrame see each other's files (measured: a union of two
projects' rows had one project's rows alone).

A claude log's project is its folder, so other folders are never listed further. A codex or openclaw log names its project
in its first lines, so those alone are read of the others. Files go to tasks by longest processing time: the largest
first, each to the task with the least so far, with no more tasks than keep the longest near the mean. The agents of a
claude session are merged while they are read, a line of each file at a time.
"""

from __future__ import annotations

import fnmatch
import heapq
import io
import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schema import SESSION
from . import files, formats
from .transcript import session

SOURCES = ("claude", "codex", "openclaw")
_HEAD_LINES = 50


@dataclass(frozen=True)
class Unit:
    """What one session is read from: a log, or the logs of a session's agents (``owner``: the session's folder)."""

    paths: tuple[str, ...]
    size: int
    owner: str | None = None
    has_root: bool = False


class Bin(InputPartition):
    def __init__(self, units: list[Unit]) -> None:
        self.units = units


def packed(units: Iterable[Unit], tasks: int) -> list[list[Unit]]:
    """Units in at most ``tasks`` bins. With fewer bins than total by largest, no bin can be much above the mean: the
    largest unit is not, and the rest fill up what is below."""
    rest = sorted(units, key=lambda u: (-u.size, u.paths))
    if not rest:
        return []
    total, largest = sum(u.size for u in rest), max(rest[0].size, 1)
    bins = max(1, min(tasks, len(rest), total // largest))
    out: list[list[Unit]] = [[] for _ in range(bins)]
    loads = [(0, n) for n in range(bins)]
    for u in rest:
        load, n = heapq.heappop(loads)
        out[n].append(u)
        heapq.heappush(loads, (load + u.size, n))
    return [b for b in out if b]


def merged_entries(streams: Sequence[Iterator[dict]]) -> Iterator[dict]:
    """Entries of several logs by time: within a log in its own order, each at the largest time so far; at a tie the
    earlier log first. One entry of each log is held."""

    def timed(n: int, entries: Iterator[dict]) -> Iterator[tuple[str, int, int, dict]]:
        latest = ""
        for k, e in enumerate(entries):
            stamp = e.get("timestamp")
            latest = max(latest, stamp if isinstance(stamp, str) else "")
            yield latest, n, k, e

    for *_, e in heapq.merge(*[timed(n, s) for n, s in enumerate(streams)], key=lambda x: x[:3]):
        yield e


class AgentLogsReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        at, self.rows = options["path"], to_arrow_schema(schema)
        self.fs, self.root = pafs.FileSystem.from_uri(at) if "://" in at else (pafs.LocalFileSystem(), at.removeprefix("file:"))
        self.source, self.thinking = options.get("source", "claude"), options.get("thinking", "true") == "true"
        if self.source not in SOURCES:
            raise ValueError(f"source must be one of {SOURCES}")
        self.pattern = options.get("pattern", "*.jsonl")
        self.tasks, self.target = int(options.get("tasks", "1000")), int(options.get("bytes", str(1 << 27)))
        self.wanted: set[str] | None = set(json.loads(options["projects"])) if "projects" in options else None

    def _list(self, folder: str, recursive: bool) -> list[pafs.FileInfo]:
        return self.fs.get_file_info(pafs.FileSelector(folder, recursive=recursive, allow_not_found=True))

    def _lines(self, path: str) -> Iterator[dict]:
        with self.fs.open_input_stream(path) as raw, io.TextIOWrapper(raw, "utf-8", errors="replace", newline="\n") as text:
            for line in text:
                yield from files.entries(line)

    def _listed(self) -> list[pafs.FileInfo]:
        """Logs that may hold a wanted project."""
        if self.source == "claude":
            # A folder is a project; a log may also lie in the root itself.
            top = self._list(self.root, False)
            folders = [f for f in top if not f.is_file and (self.wanted is None or files.claude_project(f.base_name) in self.wanted)]
            found = [f for f in top if f.is_file] + [f for d in folders for f in self._list(d.path, True)]
        else:
            found = self._list(self.root, True)
        return [f for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern)]

    def _wanted(self, path: str) -> bool:
        """Whether the first folder that a log names is a wanted project; a log that is silent may be."""
        if self.wanted is None or self.source == "claude":
            return True
        for e in islice(self._lines(path), _HEAD_LINES):
            cwd = e.get("cwd") if self.source == "openclaw" else e["payload"].get("cwd") if isinstance(e.get("payload"), dict) else None
            if cwd:
                return files.prefixed(self.source, cwd) in self.wanted
        return True

    def units(self) -> list[Unit]:
        if self.wanted is not None and not self.wanted:
            return []
        found = [f for f in self._listed() if self._wanted(f.path)]
        roots = [f for f in found if self.source != "claude" or "/subagents/" not in f.path]
        agents: dict[str, list[pafs.FileInfo]] = {}
        for f in found:
            if self.source == "claude" and fnmatch.fnmatch(f.path, "*/subagents/agent-*"):
                agents.setdefault(f.path.rsplit("/subagents/", 1)[0], []).append(f)
        owners = {f.path.rsplit(".", 1)[0] for f in roots}
        out = [Unit((f.path,), f.size) for f in roots]
        return out + [Unit(tuple(sorted(f.path for f in own)), sum(f.size for f in own), owner, owner in owners) for owner, own in sorted(agents.items())]

    def partitions(self) -> Sequence[InputPartition]:
        units = self.units()
        tasks = min(self.tasks, max(8, -(-sum(u.size for u in units) // self.target)))
        return [Bin(b) for b in packed(units, tasks)] or [Bin([])]

    def _session(self, unit: Unit) -> dict | None:
        if unit.owner is None:
            with self.fs.open_input_stream(unit.paths[0]) as f:
                text = f.read().decode("utf-8", "replace")
            return files._FILES[self.source][1](unit.paths[0], text, self.thinking)
        entries = merged_entries([self._lines(p) for p in unit.paths])
        found = session(formats.claude(entries), "claude", unit.owner.rsplit("/", 1)[-1], files.claude_project(files._folder(unit.owner)), self.thinking)
        if found and unit.has_root:
            found["session_id"] = f"{found['session_id']}:subagents"
        return found

    def read(self, part: Bin) -> Iterator[pa.RecordBatch]:
        for unit in part.units:
            if found := self._session(unit):
                yield pa.RecordBatch.from_pylist([files.row(files._clean(found))], self.rows)


class AgentLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "agent_logs"

    def schema(self) -> str:
        return SESSION

    def reader(self, schema: StructType) -> AgentLogsReader:
        return AgentLogsReader(self.options, schema)


def logs(spark: SparkSession, source: str, path: str, projects: Iterable[str] | None = None, thinking: bool = True, **options: str) -> DataFrame:
    """The sessions of claude, codex or openclaw logs below a folder, as :func:`files.read` gives them; of some
    ``projects`` only, or of all. Also ``pattern`` of file names, ``tasks`` at most and ``bytes`` of a task."""
    spark.dataSource.register(AgentLogs)
    names = None if projects is None else sorted(set(projects))
    chosen = {} if names is None else {"projects": json.dumps(names)}
    found = spark.read.format("agent_logs").options(source=source, thinking=str(thinking).lower(), **chosen, **options).load(path)
    # A log's first lines may name another project than its last ones.
    return found if names is None else found.where(F.col("project").isin(*names))
