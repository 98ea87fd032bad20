"""Union-merge of session datasets, and what decides between versions of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_key(source: Column, session_id: Column, project: Column, start_time: Column) -> Column:
    """One session has one key through drifting start times and projects, as long as it has an id."""
    own = F.concat_ws("\x1f", F.lit("sid"), F.coalesce(source, F.lit("")), session_id)
    parts = [F.coalesce(c, F.lit("\x00")) for c in (source, project, session_id, start_time)]
    return F.when(F.coalesce(session_id, F.lit("")) != "", own).otherwise(F.concat_ws("\x1f", F.lit("identity"), *parts))


def keep_best(rows: DataFrame, key: str, messages: str, size: str, end_time: str, order: list[str]) -> DataFrame:
    """One row a key: most messages, then most bytes, then the latest end; ties keep the first in ``order``."""
    best = Window.partitionBy(key).orderBy(F.desc(messages), F.desc(size), F.desc_nulls_last(end_time), *order)
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def union_merge(remote: DataFrame, local: DataFrame, key: str = "key", messages: str = "n_messages", size: str = "n_bytes", end_time: str = "end_time", line: str = "line", digest: str = "digest") -> DataFrame:
    """Winners with their class: added (local only), carried_forward (remote only), updated (a local version won) or
    unchanged. Repeated keys within a side are legal. Sides are unioned and split again by one shuffle on the key."""
    both = remote.withColumn("side", F.lit(0)).unionByName(local.withColumn("side", F.lit(1)))
    whole = Window.partitionBy(key)
    marked = both.withColumn("_remote", F.max((F.col("side") == 0).cast("int")).over(whole)).withColumn("_local", F.max((F.col("side") == 1).cast("int")).over(whole)).withColumn("_first", F.min(F.struct("side", line)).over(whole))
    kind = (
        F.when(F.col("_remote") == 0, "added")
        .when(F.col("_local") == 0, "carried_forward")
        .when(F.col("side") == 1, "updated")
        .otherwise("unchanged")
    )
    return keep_best(marked, key, messages, size, end_time, ["side", line]).withColumn("merge_class", kind).withColumn("position", F.col("_first")).drop("_remote", "_local", "_first")


def merge_stats(merged: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("merge_class") == k).alias(k)
    return merged.agg(n("added"), n("updated"), n("carried_forward"), n("unchanged"), F.count("*").alias("total"))


def publishable(merged_total: int, remote_total: int) -> None:
    """A merge never loses a session: raises where it would."""
    if merged_total < remote_total:
        raise ValueError(f"the merge has {merged_total} sessions, the published data {remote_total}")


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in an explicit order. Tasks send one row a key, so a hot key costs no task more."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return first.select([F.col("_row").getField(c).alias(c) for c in rows.columns])
