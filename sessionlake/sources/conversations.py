"""Sessions from a table of turns (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SOURCES


def sessions(turns: DataFrame) -> DataFrame:
    """One row a conversation: ids, source, project, model, message counts and lengths as stand-ins for tokens."""
    said = lambda role: F.col("role") == role
    length = F.length("text").cast("long")
    rows = turns.groupBy("conv_id").agg(
        F.count_if(said("user")).alias("user_messages"),
        F.count_if(said("assistant")).alias("assistant_messages"),
        F.coalesce(F.sum(F.when(said("user"), length)), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(said("assistant"), length)), F.lit(0)).alias("output_tokens"),
    )
    return named(rows)


def named(rows: DataFrame) -> DataFrame:
    source = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.col("conv_id") % 9 + 1).cast("int"))
    return (
        rows.withColumn("session_id", F.col("conv_id").cast("string"))
        .withColumn("source", source)
        .withColumn("project", F.concat(source, F.lit(":Proj_"), (F.col("conv_id") % 7).cast("string")))
        .withColumn("model", F.concat(F.lit("vendor/Model_"), (F.col("conv_id") % 5).cast("string"), F.lit(".0")))
    )


def messages(turns: DataFrame) -> DataFrame:
    """User and assistant turns as message rows, numbered within their session."""
    return named(turns.where(F.col("role").isin("user", "assistant")))
