"""Connected components of an edge table by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, release, stored


def connected_components(edges: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, list[str]]:
    """Label each node that occurs in ``edges`` (columns a, b of one type) with the least node of its component.

    Large-star and small-star rounds (Kiveris et al., 2014) alternate until nothing moves; each round is written to
    the shared folder. A node's neighbours are only ever reduced to their least, by partial aggregation, and the rows of
    a hub are joined with that by a broadcast of the few hubs, so that a hub costs no task more than its share. Self
    loops, repeated edges and an empty table are allowed.
    Returns (node, root) and the scratch paths that the result still reads.
    """
    spark = edges.sparkSession
    pairs = edges.where("a is not null and b is not null and a <> b")
    now, path = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before, total = None, 2 * now.count()
    for _ in range(max_rounds if total else 0):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("size"))
        # Each neighbour above a node now hangs on the least of that node's neighbourhood.
        large = join_groups(both.where("b > a"), least, "a", "size", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large, large_path = stored(large.where("a <> b").distinct(), "cc")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("size"))
        small = (
            join_groups(large, low, "a", "size", total)
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        new, new_path = stored(small, "cc")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for old in (path, large_path):
            release(spark, old)
        now, path = new, new_path
        if tuple(state) == before:
            break
        before, total = tuple(state), 2 * state[0]
    else:
        if total:
            raise RuntimeError("connected components did not settle")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct()), [path]
