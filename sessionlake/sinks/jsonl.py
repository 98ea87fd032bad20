"""Sessions as JSON lines: top-level nulls stay, absent fields of messages are absent."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEAD = ("session_id", "model", "git_branch", "start_time", "end_time", "project", "source")


def record(row: dict) -> dict:
    """A session's row as the object that is written."""
    value = lambda t: None if t is None else json.loads(t)
    messages = []
    for m in row["messages"]:
        out = {k: m[k] for k in ("role", "content", "thinking") if m[k] is not None}
        if m["content_parts"] is not None:
            out["content_parts"] = [value(p) for p in m["content_parts"]]
        if m["tool_uses"] is not None:
            tools = []
            for t in m["tool_uses"]:
                tool = {"tool": t["tool"], "input": value(t["input"])}
                tools.append(tool | {k: value(t[k]) if k == "output" else t[k] for k in ("output", "status", "id") if t[k] is not None})
            out["tool_uses"] = tools
        messages.append({**out, "timestamp": m["timestamp"]})
    out = {k: row[k] for k in _HEAD} | {"messages": messages, "stats": row["stats"]}
    return out | ({"redaction_policy": row["redaction_policy"]} if row.get("redaction_policy") else {})


def lines(sessions: DataFrame) -> DataFrame:
    """session_id, source, project, start_time and ``line``, the canonical JSON of each session."""
    from ..functions.json_values import canonical

    def plain(v):  # noqa: ANN001, ANN202
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if hasattr(v, "tolist") or isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return v

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{k: None if not isinstance(v, (dict, list)) and not hasattr(v, "tolist") and pd.isna(v) else plain(v) for k, v in r.items()} for r in frame.to_dict("records")]
            out = [(r["session_id"], r["source"], r["project"], r["start_time"], canonical(record(r))) for r in rows]
            yield pd.DataFrame(out, columns=["session_id", "source", "project", "start_time", "line"])

    return sessions.mapInPandas(run, "session_id string, source string, project string, start_time string, line string")


def write(rows: DataFrame, line: str, order: list[str], path: str, one_file: bool = False) -> None:
    """Lines in order. ``one_file`` is for small exports that other tools read as a single file."""
    out = rows.orderBy(*order).select(F.col(line).alias("value"))
    (out.coalesce(1) if one_file else out).write.mode("overwrite").text(path)


def parsed(spark, path: str) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """The records of JSON lines (line, object's keys as columns of text where merges need them), and the lines that
    are no object, verbatim."""
    text = spark.read.text(path).withColumnRenamed("value", "line").where(F.trim("line") != "")
    kind = F.schema_of_variant(F.try_parse_json("line"))
    marked = text.withColumn("_ok", F.coalesce(kind.startswith("OBJECT"), F.lit(False)))
    keys = [F.get_json_object("line", f"$.{k}").alias(k) for k in ("session_id", "source", "project", "start_time", "end_time", "model", "redaction_policy")]
    good = marked.where("_ok").select("line", *keys, F.coalesce(F.json_array_length(F.get_json_object("line", "$.messages")), F.lit(0)).alias("n_messages"))
    return good, marked.where("not _ok").select("line")
