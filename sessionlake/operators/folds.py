"""Folds over ordered log entries, as windows and aggregates by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_last(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The first and last value that is not null in order of the stream (not the least and greatest)."""
    at = F.struct(*order)
    kept = rows.where(F.col(value).isNotNull())
    return kept.groupBy(key).agg(F.min_by(value, at).alias("start_time"), F.max_by(value, at).alias("end_time"))


def turns(rows: DataFrame, key: str, order: list[str], flush: Column) -> DataFrame:
    """``turn``: entries up to and with a flush are one turn; the end of the log flushes the rest."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("turn", F.coalesce(F.sum(flush.cast("long")).over(before), F.lit(0)))


def cumulative_max(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Counters that only grow within a session: the largest is the total."""
    return rows.groupBy(key).agg(*[F.max(v).alias(v) for v in values])


def upsert_log(rows: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Entries of the same id replace each other in place: the place of the first, the values of the last. Entries
    without id stay where they are (give them one of their own before)."""
    at = F.struct(*order)
    last = F.max_by(F.struct(*columns), at).alias("_last")
    return rows.groupBy(*key).agg(F.min(at).alias("position"), last).select(*key, "position", *[F.col(f"_last.{c}").alias(c) for c in columns])


def ordered_distinct(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Distinct values that are not blank, by first appearance."""
    kept = rows.where(F.trim(F.col(value)) != "")
    first = kept.groupBy(key, value).agg(F.min(F.struct(*order)).alias("_at"))
    listed = F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("v"))))
    return first.groupBy(key).agg(F.transform(listed, lambda x: x["v"]).alias("values"))


def merged_order(rows: DataFrame, file: str, stamp: str, line: str) -> Column:
    """The order of a k-way merge of files that need not be sorted: each entry stands at the largest stamp of its file
    so far."""
    running = F.max(F.coalesce(F.col(stamp), F.lit(""))).over(Window.partitionBy(file).orderBy(line).rowsBetween(Window.unboundedPreceding, 0))
    return F.struct(running.alias("s"), F.col(file).alias("f"), F.col(line).alias("l"))
