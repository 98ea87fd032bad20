"""Structural comparison of two versions of a dataset, as multisets of records by identity key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def counted(rows: DataFrame, key: str, digest: str) -> DataFrame:
    return rows.groupBy(key, digest).agg(F.count("*").alias("n"))


def multiset_difference(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, digest, removed, added: how many more of a record one side has."""
    a, b = counted(old, key, digest).withColumnRenamed("n", "n_old"), counted(new, key, digest).withColumnRenamed("n", "n_new")
    both = a.join(b, [key, digest], "full_outer").fillna(0, ["n_old", "n_new"])
    return both.where("n_old <> n_new").select(key, digest, F.greatest(F.col("n_old") - F.col("n_new"), F.lit(0)).alias("removed"), F.greatest(F.col("n_new") - F.col("n_old"), F.lit(0)).alias("added"))


def changed_keys(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    return multiset_difference(old, new, key, digest).select(key).distinct()


def _expanded(rows: DataFrame, difference: DataFrame, side: str, key: str, digest: str, line: str) -> DataFrame:
    """The surplus records of a side, one row each, numbered within their key by record and line.

    Few keys may hold most records: a key is numbered in buckets by how the digest begins (two hexadecimal digits, so
    the order stays), whose counts are then summed up."""
    same = F.row_number().over(Window.partitionBy(key, digest).orderBy(F.desc(line)))
    surplus = rows.select(key, digest, line).join(difference.where(F.col(side) > 0).select(key, digest, side), [key, digest]).withColumn("_k", same).where(F.col("_k") <= F.col(side))
    marked = surplus.withColumn("_bucket", F.substring(digest, 1, 2))
    counts = difference.where(F.col(side) > 0).groupBy(key, F.substring(digest, 1, 2).alias("_bucket")).agg(F.sum(side).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.withColumn("_base", F.coalesce(before, F.lit(0))).drop("_n")
    n = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(digest, line)) + F.col("_base")
    return marked.join(bases, [key, "_bucket"]).select(key, n.cast("long").alias("n"), F.col(digest).alias(f"{side}_digest"), F.col(line).alias(f"{side}_line"))


def events(old: DataFrame, new: DataFrame, key: str = "key", digest: str = "digest", line: str = "line") -> DataFrame:
    """key, n, event (modified, removed, added), removed_digest, removed_line, added_digest, added_line.

    Surplus records of a key are paired in order; what is left over on a side was removed or added. Records that both
    sides hold equally often give no event.
    """
    difference = multiset_difference(old, new, key, digest)
    gone, come = _expanded(old, difference, "removed", key, digest, line), _expanded(new, difference, "added", key, digest, line)
    both = gone.join(come, [key, "n"], "full_outer")
    kind = F.when(F.col("removed_digest").isNull(), "added").when(F.col("added_digest").isNull(), "removed").otherwise("modified")
    return both.withColumn("event", kind)


def diff_summary(old: DataFrame, new: DataFrame, key: str = "key", digest: str = "digest", line: str = "line") -> DataFrame:
    """One row of counts. ``unchanged_records`` counts records of keys whose whole multiset is equal."""
    changed = changed_keys(old, new, key, digest)
    same = new.join(changed, key, "left_anti").agg(F.count("*").alias("unchanged_records"))
    n = lambda k: F.count_if(F.col("event") == k).alias(k)
    return events(old, new, key, digest, line).agg(n("modified"), n("removed"), n("added"), F.countDistinct(key).alias("changed_keys")).join(F.broadcast(same))
