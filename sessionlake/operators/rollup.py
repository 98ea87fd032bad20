"""Rollups: sessions and tokens by model and by project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import model_key, project_key

_SUMS = (F.count, "sessions"), (F.sum, "input_tokens"), (F.sum, "output_tokens")


def breakdown(sessions: DataFrame, key: Column, name: str, sessions_col: Column | None = None) -> DataFrame:
    """name, sessions, input_tokens, output_tokens for each key that is not null. One shuffle, of partial sums."""
    n = F.count("*") if sessions_col is None else F.sum(sessions_col)
    return (
        sessions.withColumn("_key", key)
        .where("_key is not null")
        .groupBy(F.col("_key").alias(name))
        .agg(n.alias("sessions"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    )


def by_model(sessions: DataFrame) -> DataFrame:
    return breakdown(sessions, model_key(F.col("model")), "model")


def by_project(sessions: DataFrame) -> DataFrame:
    return breakdown(sessions, project_key(F.col("project")), "project")


def renormalized(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """Breakdown rows whose keys were written before keys were normalized, summed up again by their normal key."""
    return breakdown(rows, key, name, F.col("sessions"))


def from_legacy(counts: DataFrame, key: Column, name: str) -> DataFrame:
    """A breakdown from what older metadata holds: keys with a number of sessions (null: only the name is known) and no
    tokens. Keys that are the same when normalized are summed up."""
    zero = F.lit(0).cast("long")
    own = counts.withColumn("sessions", F.coalesce(F.col("sessions").cast("long"), zero)).withColumn("input_tokens", zero).withColumn("output_tokens", zero)
    return renormalized(own, key, name)


def summary(sessions: DataFrame) -> DataFrame:
    """Totals and both breakdowns in one pass: kind (model, project, total), key, sums."""
    keyed = sessions.select(model_key(F.col("model")).alias("model"), project_key(F.col("project")).alias("project"), "input_tokens", "output_tokens")
    grouped = keyed.groupingSets([["model"], ["project"], []], "model", "project").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("sessions"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )
    kind = F.when(F.col("_g") == 1, "model").when(F.col("_g") == 2, "project").otherwise("total")
    out = grouped.select(kind.alias("kind"), F.coalesce("model", "project").alias("key"), "sessions", "input_tokens", "output_tokens")
    return out.where("kind = 'total' or key is not null")


def ordered(rows: DataFrame, name: str) -> DataFrame:
    return rows.orderBy(F.desc("output_tokens"), F.asc(name))


def review_counts(sessions: DataFrame, key: str, line: str) -> DataFrame:
    """Sessions by project or model (``<unknown>`` where missing), most first, equal counts in order of appearance."""
    value = F.coalesce(F.when(F.col(key) != "", F.col(key)), F.lit("<unknown>"))
    return sessions.groupBy(value.alias(key)).agg(F.count("*").alias("sessions"), F.min(line).alias("first_line")).orderBy(F.desc("sessions"), "first_line")


def project_state(sessions: DataFrame) -> DataFrame:
    """What an export remembers of each project."""
    has = (F.col("input_tokens") > 0) | (F.col("output_tokens") > 0)
    return sessions.groupBy("project").agg(
        F.count("*").alias("sessions"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.bool_or(has).alias("has_token_stats")
    )


def project_catalog(files: DataFrame) -> DataFrame:
    """source, project, session_count, total_size_bytes of a listing (source, project, bytes), by name and source."""
    return files.groupBy("source", "project").agg(F.count("*").alias("session_count"), F.sum("bytes").alias("total_size_bytes")).orderBy("project", "source")


def proportional(rows: DataFrame, value: str, whole: Column, name: str) -> DataFrame:
    """Each row's share of ``whole`` in proportion to ``value``. The total is an aggregate joined back, not a window
    over everything, so no task gets all rows."""
    total = rows.agg(F.sum(value).alias("_total"))
    return rows.join(F.broadcast(total)).withColumn(name, F.when(F.col("_total") > 0, F.floor(whole * F.col(value) / F.col("_total"))).otherwise(0).cast("long")).drop("_total")
