"""Directories known by a hash of their path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefixes(rows: DataFrame, path: str) -> DataFrame:
    """Every leading part of a path, at its slashes: the other columns and ``prefix``."""
    parts = F.split(F.col(path), "/")
    leading = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return rows.select(*[c for c in rows.columns if c != path], F.explode(leading).alias("prefix"))


def resolve_hashes(hashes: DataFrame, candidates: DataFrame, hash_col: str, path: str, kind: str = "sha256") -> DataFrame:
    """The candidates whose hash is known: an equi join on the computed hash."""
    digest = F.md5(path) if kind == "md5" else F.sha2(path, 256)
    return candidates.withColumn(hash_col, digest).join(hashes.select(hash_col).distinct(), hash_col)
