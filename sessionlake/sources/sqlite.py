"""Sessions from SQLite stores (cursor, hermes, opencode), by a read-only Python data source.

Tables are read in ranges of row ids, a task each; joins and orders are Spark's. Text columns alone are read, numbers
too as text with their type kept by a cast in the query.
"""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import SESSION
from . import formats
from .files import _COLUMNS, _clean, prefixed, row
from .transcript import session


def connect(path: str) -> sqlite3.Connection:
    """Read-only; a store that is being written to, or lies on a read-only disk, is opened as it is."""
    try:
        out = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        out.execute("select 1 from sqlite_master limit 1").fetchall()
        return out
    except sqlite3.Error:
        return sqlite3.connect(f"file:{path}?immutable=1", uri=True)


#: What this worker has open: by path, the store's size and time when it was opened, and the connection.
_OPEN: dict[str, tuple[tuple[int, int], sqlite3.Connection]] = {}


def snapshot(path: str) -> sqlite3.Connection:
    """The worker's connection to a store: one for all ranges that it reads, opened anew when the store has changed."""
    about = os.stat(path)
    seen = about.st_size, about.st_mtime_ns
    known = _OPEN.get(path)
    if known and known[0] == seen:
        return known[1]
    if known:
        known[1].close()
    _OPEN[path] = seen, connect(path)
    return _OPEN[path][1]


class Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.path, self.table, self.columns = options["path"], options["table"], columns
        self.rows = int(options.get("rows", "100000"))

    def partitions(self) -> list[Range]:
        with connect(self.path) as c:
            low, high = c.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        if low is None:
            return [Range(0, -1)]
        return [Range(i, min(i + self.rows - 1, high)) for i in range(low, high + 1, self.rows)]

    def read(self, part: Range) -> Iterator[tuple]:
        with snapshot(self.path) as c:
            there = {r[1] for r in c.execute(f'pragma table_info("{self.table}")')}
            named = ", ".join(f'"{k}"' if k in there else "null" for k in self.columns)
            text = lambda v: v.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode() if isinstance(v, bytes) else v if v is None or isinstance(v, str) else json.dumps(v)
            for r in c.execute(f'select {named} from "{self.table}" where rowid between ? and ?', (part.low, part.high)):
                yield tuple(map(text, r))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_ro").schema("a string, ...").option("table", ...).load(path)``; every column is text,
    null where the table lacks it."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_ro"

    def schema(self) -> str:
        with connect(self.options["path"]) as c:
            return ", ".join(f"`{r[1]}` string" for r in c.execute(f'pragma table_info("{self.options["table"]}")'))

    def reader(self, schema) -> SqliteReader:  # noqa: ANN001
        return SqliteReader(dict(self.options), schema.fieldNames())


def table(spark: SparkSession, path: str, name: str, columns: list[str], rows: int = 100_000) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("sqlite_ro").schema(schema).option("table", name).option("rows", str(rows)).load(path)


def _sessions(grouped: DataFrame, parse) -> DataFrame:  # noqa: ANN001
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [parse(r) for r in frame.itertuples(index=False)]
            yield pd.DataFrame([row(_clean(s)) for s in found if s], columns=_COLUMNS)

    return grouped.mapInPandas(run, SESSION)


def cursor(spark: SparkSession, path: str, thinking: bool = True) -> DataFrame:
    """Conversations of two bubbles or more: headers in order, each looked up by an equi join."""
    kv = table(spark, path, "cursorDiskKV", ["key", "value"])
    composers = kv.where(F.col("key").startswith("composerData:")).select(F.substring("key", 14, 1 << 30).alias("cid"), "value")

    @F.pandas_udf("array<string>")
    def headers(values: pd.Series) -> pd.Series:
        return pd.Series([formats.cursor_headers(v if isinstance(v := formats.parsed(x), dict) else {}) for x in values])

    order = composers.withColumn("ids", headers("value")).where(F.size("ids") >= 2).select("cid", F.posexplode("ids").alias("pos", "bid"))
    bubbles = kv.where(F.col("key").startswith("bubbleId:")).select(F.element_at(F.split("key", ":"), 2).alias("cid"), F.element_at(F.split("key", ":"), -1).alias("bid"), "value")
    rows = order.join(bubbles, ["cid", "bid"], "left")
    grouped = rows.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("bubbles"))

    def parse(r) -> dict | None:  # noqa: ANN001
        values = [formats.parsed(b["value"]) for b in r.bubbles if b["value"]]
        events = list(formats.cursor([v for v in values if isinstance(v, dict)]))
        cwd = next((e.value for e in events if getattr(e, "key", None) == "cwd" and e.value), None)
        return session(events, "cursor", r.cid, prefixed("cursor", cwd), thinking)

    return _sessions(grouped, parse)


_HERMES_SESSION = ["id", "source", "model", "started_at", "ended_at", "message_count", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]
_HERMES_MESSAGE = ["id", "session_id", "role", "content", "tool_call_id", "tool_calls", "timestamp", *formats._REASONING]
_HERMES_NUMBERS = ("started_at", "ended_at", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "timestamp")


def _number(key: str, value: str | None, numbers: tuple[str, ...]) -> object:
    if value is None or key not in numbers:
        return value
    try:
        return json.loads(value)
    except ValueError:
        return value


def hermes(spark: SparkSession, path: str, thinking: bool = True) -> DataFrame:
    """Sessions that have messages, those by time and id."""
    own = table(spark, path, "sessions", _HERMES_SESSION).where(F.coalesce(F.col("message_count").cast("long"), F.lit(0)) > 0)
    said = table(spark, path, "messages", _HERMES_MESSAGE)
    at = F.struct(F.col("timestamp").cast("double").alias("t"), F.col("id").cast("long").alias("i"), F.struct(*_HERMES_MESSAGE).alias("m"))
    lists = said.groupBy(F.col("session_id").alias("sid")).agg(F.array_sort(F.collect_list(at)).alias("messages"))

    def parse(r) -> dict | None:  # noqa: ANN001
        head = {k: _number(k, getattr(r, k), _HERMES_NUMBERS) for k in _HERMES_SESSION}
        rows = [{k: _number(k, x["m"][k], _HERMES_NUMBERS) for k in _HERMES_MESSAGE} for x in r.messages]
        return session(formats.hermes(head, rows), "hermes", head["id"], f"hermes:{head['source'] or 'unknown'}", thinking)

    return _sessions(own.join(lists, F.col("id") == F.col("sid")), parse)


def opencode(spark: SparkSession, path: str, thinking: bool = True) -> DataFrame:
    """Sessions, their messages and their parts: two equi joins, each level by time and id."""
    own = table(spark, path, "session", ["id", "directory", "time_created", "time_updated"])
    said = table(spark, path, "message", ["id", "session_id", "time_created", "data"])
    parts = table(spark, path, "part", ["id", "message_id", "time_created", "data"])
    when = F.col("time_created").cast("long").alias("t")
    inner = parts.groupBy(F.col("message_id").alias("mid")).agg(F.array_sort(F.collect_list(F.struct(when, "id", "data"))).alias("parts"))
    outer = said.join(inner, F.col("id") == F.col("mid"), "left").groupBy(F.col("session_id").alias("sid")).agg(F.array_sort(F.collect_list(F.struct(when, "id", "data", "parts"))).alias("messages"))

    def parse(r) -> dict | None:  # noqa: ANN001
        head = {"id": r.id, "time_created": int(r.time_created) if r.time_created else None, "time_updated": int(r.time_updated) if r.time_updated else None}
        rows = [({"time_created": m["t"], "data": m["data"]}, [{"data": p["data"]} for p in (m["parts"] if m["parts"] is not None else [])]) for m in r.messages]
        return session(formats.opencode(head, rows), "opencode", r.id, prefixed("opencode", r.directory), thinking)

    return _sessions(own.join(outer, F.col("id") == F.col("sid")), parse)


READERS = {"cursor": cursor, "hermes": hermes, "opencode": opencode}


def sizes(spark: SparkSession, source: str, path: str) -> DataFrame:
    """An estimate of each session's bytes: id, bytes."""
    if source == "cursor":
        kv = table(spark, path, "cursorDiskKV", ["key", "value"])
        return kv.where(F.col("key").startswith("bubbleId:")).groupBy(F.element_at(F.split("key", ":"), 2).alias("id")).agg(F.sum(F.length("value")).alias("bytes"))
    if source == "opencode":
        said = table(spark, path, "message", ["id", "session_id", "data"])
        parts = table(spark, path, "part", ["message_id", "data"]).groupBy("message_id").agg(F.sum(F.length("data")).alias("p"))
        rows = said.join(parts, F.col("id") == F.col("message_id"), "left")
        return rows.groupBy(F.col("session_id").alias("id")).agg(F.sum(F.length("data") + F.coalesce("p", F.lit(0))).alias("bytes"))
    import os

    from ..operators.rollup import proportional

    own = table(spark, path, "sessions", ["id", "message_count"]).select("id", F.coalesce(F.col("message_count").cast("long"), F.lit(0)).alias("n"))
    return proportional(own, "n", F.lit(os.path.getsize(path)), "bytes").select("id", "bytes")
