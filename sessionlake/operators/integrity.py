"""Whether two datasets are the same, and where they differ, by a tree of hashes that no layout changes.

Rows fall into leaves by a hash of their key. A leaf is the sum, modulo 2**32 in eight columns, of the SHA-256 words of its
rows: order, files and partitions play no part, a row that is there twice counts twice, and tasks send sums. Inner nodes
hash their children. Trees are compared from the root down; below equal nodes nothing is looked at, so only rows of
unequal leaves are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
BITS = 4  # of a level: a node has 16 children


def leaf_of(key: Column, levels: int = 3) -> Column:
    """The leaf of a key: as many hexadecimal digits as the tree has levels. Null is a key of its own."""
    return F.substring(F.sha2(F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("")), 256), 1, levels)


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's columns, told apart from each other and from nulls."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def leaves(rows: DataFrame, key: str, digest: Column, levels: int = 3) -> DataFrame:
    """node (the leaf's digits), hash and rows of each leaf that has rows. At most 16 ** levels."""
    own = rows.select(leaf_of(F.col(key), levels).alias("node"), digest.alias("_d"))
    words = [F.sum(F.conv(F.substring("_d", 8 * w + 1, 8), 16, 10).cast("long")).alias(f"w{w}") for w in range(WORDS)]
    sums = own.groupBy("node").agg(F.count("*").alias("rows"), *words)
    mixed = F.sha2(F.concat_ws(":", "rows", *[(F.col(f"w{w}") % (1 << 32)).cast("string") for w in range(WORDS)]), 256)
    return sums.select("node", mixed.alias("hash"), "rows")


def tree(leaf_rows: DataFrame, levels: int = 3) -> DataFrame:
    """node, hash, rows of all nodes; the root is the empty node. A node's hash is of its children's digits and hashes.
    The table is as large as the number of leaves, a fixed number, whatever the data."""
    level = leaf_rows
    out = leaf_rows
    for n in reversed(range(levels)):
        child = F.concat(F.substring("node", -1, 1), F.lit("="), F.col("hash"))
        level = level.groupBy(F.substring("node", 1, n).alias("node")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(child)), ","), 256).alias("hash"), F.sum("rows").alias("rows"))
        out = out.unionByName(level)
    return out


def root(nodes: DataFrame) -> str | None:
    """The dataset's hash; None where it has no rows."""
    found = nodes.where("node = ''").first()
    return found["hash"] if found else None


def unequal_leaves(a: DataFrame, b: DataFrame, levels: int = 3) -> list[str]:
    """The leaves in which two trees differ, level by level from the root: of each level only the children of unequal
    nodes are looked at."""
    nodes = [""]
    for n in range(levels + 1):
        under = lambda t: t.where(F.length("node") == n).where(F.substring("node", 1, max(n - 1, 0)).isin(nodes) if n else F.lit(True)).select("node", "hash")  # noqa: B023, E731
        both = under(a).join(under(b).withColumnRenamed("hash", "other"), "node", "full")
        nodes = sorted(r["node"] for r in both.where(~F.col("hash").eqNullSafe(F.col("other"))).collect())
        if not nodes:
            return []
    return nodes


def differences(old: DataFrame, new: DataFrame, key: str, columns: list[str], levels: int = 3) -> DataFrame:
    """key, removed, added: how many rows of a key are in one dataset alone, found by reading rows of unequal leaves
    only. Rows that changed are one removed and one added."""
    digest, spark = row_digest(columns), old.sparkSession
    # The leaves' hashes, at most 16 ** levels rows, are computed once and compared from there.
    fixed = lambda found: spark.createDataFrame(found.collect(), found.schema)
    where = unequal_leaves(*[fixed(tree(leaves(rows, key, digest, levels), levels)) for rows in (old, new)], levels)
    near = lambda rows: rows.where(leaf_of(F.col(key), levels).isin(where) if where else F.lit(False)).select(key, digest.alias("_d"))
    both = near(old).withColumn("_n", F.lit(-1)).unionByName(near(new).withColumn("_n", F.lit(1)))
    net = both.groupBy(key, "_d").agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return net.groupBy(key).agg(F.sum(F.greatest(-F.col("_n"), F.lit(0))).alias("removed"), F.sum(F.greatest(F.col("_n"), F.lit(0))).alias("added"))
