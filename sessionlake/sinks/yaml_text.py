"""YAML documents: keys in their order, texts of several lines as blocks."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = re.compile(r"[A-Za-z_/<][A-Za-z0-9_ ./<>()+-]*")
#: Words that YAML reads as something other than text.
_WORDS = {"true", "false", "yes", "no", "on", "off", "null", "y", "n"}


def _scalar(value: object, indent: str) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return json.dumps(value)
    text = str(value)
    if "\n" in text and not re.search(r"[^\x09\x0A\x20-\x7E\xA0-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]|[\u2028\u2029\uFEFF]", text) and not text.startswith((" ", "\n", "\t")):
        keep = "" if text.endswith("\n") and not text.endswith("\n\n") else "+" if text.endswith("\n") else "-"
        lines = text[:-1].split("\n") if text.endswith("\n") else text.split("\n")
        return f"|{keep}\n" + "\n".join(indent + line if line else "" for line in lines)
    return text if _PLAIN.fullmatch(text) and text.lower() not in _WORDS and text == text.strip() else json.dumps(text, ensure_ascii=False)


def dump(value: object, depth: int = 0) -> str:
    """A JSON value as YAML, without the document's end."""
    pad = "  " * depth
    if isinstance(value, dict) and value:
        out = []
        for k, v in value.items():
            nested = isinstance(v, (dict, list)) and v
            out.append(f"{pad}{_scalar(k, '')}:" + ("\n" + dump(v, depth + 1) if nested else " " + dump(v, depth + 1).lstrip(" ")))
        return "\n".join(out)
    if isinstance(value, list) and value:
        return "\n".join(f"{pad}- " + dump(v, depth + 1).removeprefix("  " * (depth + 1)) for v in value)
    if value == {} or value == []:
        return pad + ("{}" if value == {} else "[]")
    return pad + _scalar(value, "  " * max(depth, 1))


@F.pandas_udf(T.StringType())
def yaml_udf(lines: pd.Series) -> pd.Series:
    return lines.map(lambda t: dump(json.loads(t)), na_action="ignore")


def write_yaml(lines: DataFrame, line: str, order: list[str], path: str) -> None:
    """JSON lines as YAML documents, in order, in text files."""
    lines.orderBy(*order).select(F.concat(F.lit("---\n"), yaml_udf(F.col(line)))).write.text(path)
