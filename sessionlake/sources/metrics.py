"""What a scan met on its way: counts of lines, taken while they are read, without another pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _kinds(column: str) -> list[Column]:
    line = F.col(column)
    blank = F.trim(F.coalesce(line, F.lit(""))) == ""
    parsed = F.try_parse_json(line)
    broken = ~blank & parsed.isNull()
    other = ~blank & parsed.isNotNull() & ~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return [F.count("*").alias("lines"), F.count_if(blank).alias("blank"), F.count_if(broken).alias("malformed"), F.count_if(other).alias("not_objects")]


def counted(lines: DataFrame, to: Observation | str, column: str = "value") -> DataFrame:
    """``lines``, which are counted into ``to`` as they pass: all, blank, malformed, and JSON that is no object. On a table
    ``to`` is an observation, whose counts are there after an action; on a stream a name, under which each batch reports
    them (``observedMetrics`` of its progress)."""
    return lines.observe(to, *_kinds(column))
