"""Ranks of all rows in an order: ranges of the order, sorted one by one, and their counts summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions, stored

_ROW_BITS = 33  # of monotonically_increasing_id: the lower bits count the rows of a partition


def ranked(rows: DataFrame, group: str | None, order: list[str], rank: str, size: str, name: str) -> tuple[DataFrame, str]:
    """``rows`` with a gapless number from 0 within each ``group`` (a column without nulls; None: all rows) as ``rank``,
    and the rows of the group as ``size``; also the path of the scratch table below.

    Ascending, nulls first. Ranges are cut by group and order together, so neither a large group nor a value that many
    rows share is one task; only rows equal in every column of ``order`` are, and those take any order. Each range is
    sorted and written once, a row's place in it kept; what is summed up is a count for each range and group."""
    spark, by = rows.sparkSession, [*([group] if group else []), *order]
    cut = rows.repartitionByRange(shuffle_partitions(spark), *by).sortWithinPartitions(*by)
    placed, path = stored(cut.withColumn("_place", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_range", F.shiftright("_place", _ROW_BITS)).withColumn("_within", F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)).drop("_place")
    keys = [*([group] if group else []), "_range"]
    runs = placed.groupBy(*keys).agg(F.count("*").alias("_rows"), F.min("_within").alias("_first"))
    whole = Window.partitionBy(*([group] if group else []))
    before = F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*keys, (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_base"), F.sum("_rows").over(whole).alias(size))
    # Without groups there is a row for each range; with them, one more for each group.
    found = placed.join(runs if group else F.broadcast(runs), keys)
    return found.withColumn(rank, F.col("_base") + F.col("_within")).drop("_base", "_within", "_range"), path
