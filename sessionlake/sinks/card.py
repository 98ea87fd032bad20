"""A dataset's card and metadata: a short report of its rollups, and all of them as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..operators import rollup


def _size(n: int) -> str:
    for limit, unit, digits in ((1e9, "B", 1), (1e6, "M", 1), (1e3, "K", 0)):
        if n >= limit:
            return f"{n / limit:.{digits}f}{unit}"
    return str(n)


def card(sessions: DataFrame, name: str, most: int = 1000) -> str:
    """Markdown from the breakdowns of ``sessions`` (model, project, input_tokens, output_tokens). A table of keys has
    at most ``most`` rows: it is a report."""
    total = sessions.selectExpr("count(*) n", "coalesce(sum(input_tokens), 0) i", "coalesce(sum(output_tokens), 0) o").first()
    out = [f"# {name}", "", f"{total['n']} sessions, {_size(total['i'])} input tokens, {_size(total['o'])} output tokens.", ""]
    for title, rows, key in (("Models", rollup.by_model(sessions), "model"), ("Projects", rollup.by_project(sessions), "project")):
        out += [f"## {title}", "", f"| {key} | sessions | input tokens | output tokens |", "| --- | ---: | ---: | ---: |"]
        shown = rollup.ordered(rows, key).limit(most).collect()
        out += [f"| {r[key]} | {r['sessions']} | {_size(r['input_tokens'] or 0)} | {_size(r['output_tokens'] or 0)} |" for r in shown] or ["| none | 0 | 0 | 0 |"]
        if len(shown) == most and (left := rows.count() - most) > 0:
            out += ["", f"{left} more are not shown."]
        out.append("")
    return "\n".join(out)


def metadata(sessions: DataFrame, exported_at: str) -> str:
    """Totals and both breakdowns as pretty JSON, by one pass over ``sessions``. Keys are as many as models and
    projects, so this is for the driver to write beside a dataset."""
    out: dict = {"exported_at": exported_at, "sessions": 0, "input_tokens": 0, "output_tokens": 0, "model_breakdown": {}, "project_breakdown": {}}
    for r in rollup.summary(sessions).orderBy("kind", "key").collect():
        sums = {k: r[k] or 0 for k in ("sessions", "input_tokens", "output_tokens")}
        if r["kind"] == "total":
            out |= sums
        else:
            out[f"{r['kind']}_breakdown"][r["key"]] = sums
    return json.dumps(out, indent=2, ensure_ascii=False)
