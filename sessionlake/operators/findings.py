"""Findings of a scan and the registry of those seen so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finding_fingerprint


def registry(findings: DataFrame) -> DataFrame:
    """entity, text, n, first_seen, last_seen of each fingerprint (findings: entity, text, seen)."""
    return findings.groupBy(finding_fingerprint(F.col("entity"), F.col("text")).alias("fingerprint")).agg(
        F.first("entity").alias("entity"), F.first("text").alias("text"), F.count("*").alias("n"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen")
    )


def updated_registry(known: DataFrame, findings: DataFrame) -> DataFrame:
    """The registry with a scan's findings added: one aggregation over both."""
    return known.unionByName(registry(findings)).groupBy("fingerprint").agg(
        F.first("entity").alias("entity"), F.first("text").alias("text"), F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def split_by_registry(findings: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings that are in the registry, and new ones."""
    marked = findings.withColumn("fingerprint", finding_fingerprint(F.col("entity"), F.col("text")))
    return marked.join(known, "fingerprint", "left_semi"), marked.join(known, "fingerprint", "left_anti")
