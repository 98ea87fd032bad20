"""Keyed pairing of calls with results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pair_calls(calls: DataFrame, results: DataFrame, keys: list[str], order: str, payload: str, name: str = "output") -> DataFrame:
    """Every call with its result, in whichever order they stand: the last result of a key wins; calls without one
    stay. The results are reduced by partial aggregation before the join."""
    last = results.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.max_by(payload, order).alias(name))
    return calls.join(last, keys, "left")


def orphan_results(calls: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    return results.join(calls.select(*keys), keys, "left_anti")


def pair_fifo(calls: DataFrame, results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The n-th call of a key with its n-th result: both sides numbered, then an equi join."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long")
    return calls.withColumn("n", number).join(results.withColumn("n", number).select(*keys, "n", F.col(order).alias(f"result_{order}"), *[F.col(c).alias(f"result_{c}") for c in results.columns if c not in (*keys, order)]), [*keys, "n"], "left")
