"""Operator 2: shards by balanced label propagation.

Documents are linked where they belong together (for the query: equal texts). Rows start spread evenly, counts at most
one apart. In each round a row asks for the shard that holds most of its linked neighbours. Requests from shard i to
shard j are granted up to quotas that keep every shard's count: direct swaps first, then room made by unlinked rows,
which cost no cut edge wherever they are. Rounds end when a round grants nothing or cuts no fewer links. Groups are hubs: the neighbours of a
row are counted once a group and shard, by partial aggregation, so a group with a third of all rows costs no task more.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, stored


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str, per_bucket: int = 100_000, total: int | None = None) -> DataFrame:
    """``rows`` with a gapless number from 0 within each ``group`` as column ``name``; ``order`` must make rows
    distinct, or equal rows are numbered in any order. A group is numbered in buckets by a hash of ``order``, and the
    buckets' counts are then summed up, so no task holds a whole group."""
    buckets = max(8, -(-(rows.count() if total is None else total) // per_bucket))
    # xxhash64 of what orders the rows deals a group's rows evenly.
    marked = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = marked.groupBy(*group, "_bucket").count()
    before = F.sum("count").over(Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.withColumn("_base", F.coalesce(before, F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)) - 1
    return marked.withColumn("_within", within).join(bases, [*group, "_bucket"]).withColumn(name, F.col("_base") + F.col("_within")).drop("_bucket", "_within", "_base")


def quotas(asked: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many requests i to j are granted, and how many unlinked rows go i to j in return, so that every shard's
    count stays: ``asked`` (shards x shards), ``free`` unlinked rows of each shard. Requests go round in cycles, the
    shortest first; unlinked rows close the paths that are left."""
    granted = np.minimum(asked, asked.T)
    left, room, n = asked - granted, free.copy(), len(free)
    back = np.zeros_like(asked)

    def path(a: int, b: int) -> list[int] | None:
        """The shortest way from a to b along requests."""
        came, queue = {a: a}, [a]
        for i in queue:
            for j in np.flatnonzero(left[i]).tolist():
                if j not in came:
                    came[j] = i
                    queue.append(j)
        if b not in came:
            return None
        way = [b]
        while way[-1] != a:
            way.append(came[way[-1]])
        return way[::-1]

    def grant(way: list[int], most: int) -> None:
        for i, j in zip(way, way[1:]):
            granted[i, j] += most
            left[i, j] -= most

    for i in range(n):
        for j in np.flatnonzero(left[i]).tolist():
            while left[i, j] and (way := path(j, i)):
                grant([i, *way], min(left[x, y] for x, y in zip([i, *way], way)))
    for i, j in sorted(zip(*np.nonzero(left)), key=lambda e: (-left[e], e)):
        most = min(left[i, j], room[j])
        grant([int(i), int(j)], most)
        back[j, i] += most
        room[j] -= most
    return granted, back


def shards(rows: DataFrame, n: int = 8, key: str = "id", hub: str = "hub") -> tuple[DataFrame, list[dict]]:
    """``rows`` (columns ``key``, distinct, and ``hub``, null for unlinked rows) with column shard, counts at most one
    apart, and for each round the cut links and the moves. Cut links: rows away from their group's largest shard."""
    total = rows.count()
    start = numbered(rows.withColumn("_all", F.lit(0)), ["_all"], [key], "_n", total=total).withColumn("shard", F.pmod("_n", F.lit(n)).cast("int")).drop("_all", "_n")
    now, path = stored(start, "shards")
    log: list[dict] = []
    linked = F.col(hub).isNotNull()
    while True:
        held = now.where(linked).groupBy(hub, "shard").agg(F.count("*").alias("held"))
        # The largest shard of a group; a hash of both at a tie, so that groups spread evenly. The group's rows elsewhere
        # would like to be there.
        top = held.groupBy(hub).agg(F.max(F.struct("held", F.xxhash64(hub, "shard").alias("tie"), "shard")).alias("top"), F.sum("held").alias("all"))
        goal = top.where("all > 1").select(hub, F.col("top.shard").alias("to"), F.col("top.held").alias("pull"), "all")
        # Groups of more than a ten-thousandth of all rows number fewer than ten thousand: their goals are broadcast,
        # and no key of the other join has more rows than that.
        large = max(1000, total // 10_000)
        hot, cool = F.broadcast(goal.where(F.col("all") > large).drop("all")), goal.where(F.col("all") <= large).drop("all")
        near = now.where(linked).join(hot, hub, "left")
        found = near.where("to is not null")
        others = near.where("to is null").drop("to", "pull").join(cool, hub, "left")
        alone = now.where(~linked).withColumn("to", F.lit(None).cast("int")).withColumn("pull", F.lit(None).cast("long"))
        wish = found.unionByName(others).unionByName(alone)
        moves = F.col("to").isNotNull() & (F.col("to") != F.col("shard"))
        # Unlinked rows, and those alone in their group, may go anywhere.
        loose = F.col("to").isNull()
        marked = wish.select(*now.columns, F.when(moves, F.col("to")).alias("to"), loose.alias("loose"), F.when(moves, F.floor(F.log2(F.col("pull")))).otherwise(0).cast("int").alias("pull"))
        marked, marked_path = stored(marked, "shards-wish")
        asked, free = np.zeros((n, n), dtype=np.int64), np.zeros(n, dtype=np.int64)
        for r in marked.where("to is not null or loose").groupBy("shard", "to", "loose").count().collect():
            if r["to"] is None:
                free[r["shard"]] += r["count"]
            else:
                asked[r["shard"], r["to"]] += r["count"]
        granted, back = quotas(asked, free)
        log.append({"cut": int(asked.sum()), "moved": int(granted.sum())})
        # Cut links fall from round to round, so there is an end: when nothing is granted, or when they did not fall.
        if not granted.sum() or len(log) > 1 and log[-1]["cut"] >= log[-2]["cut"]:
            release(rows.sparkSession, marked_path)
            break
        # The strongest pull first; among equals by number.
        ranked = numbered(marked.where("to is not null").withColumn("_pull", -F.col("pull")), ["shard", "to", "_pull"], [key], "_n", total=total).drop("_pull")
        sizes = ranked.groupBy("shard", "to", "pull").count()
        ahead = F.sum("count").over(Window.partitionBy("shard", "to").orderBy(F.desc("pull")).rowsBetween(Window.unboundedPreceding, -1))
        ranked = ranked.join(sizes.withColumn("_ahead", F.coalesce(ahead, F.lit(0))).drop("count"), ["shard", "to", "pull"])
        go = F.col("_n") + F.col("_ahead") < _cell(granted, F.col("shard") * n + F.col("to"))
        moved = ranked.select(*[c for c in now.columns if c != "shard"], F.when(go, F.col("to")).otherwise(F.col("shard")).alias("shard"))
        given = np.cumsum(back, axis=1)  # loose rows of shard i number [given[i, j - 1], given[i, j]) go to j
        slots = numbered(marked.where("loose"), ["shard"], [key], "_n", total=total)
        goes = F.col("shard")
        for j in reversed(range(n)):
            goes = F.when((F.col("_n") < _cell(given, F.col("shard") * n + j)) & (F.lit(j) != F.col("shard")), j).otherwise(goes)
        left = slots.select(*[c for c in now.columns if c != "shard"], goes.cast("int").alias("shard"))
        stay = marked.where("to is null and not loose").select(*[c for c in now.columns if c != "shard"], "shard")
        new, new_path = stored(moved.unionByName(left).unionByName(stay), "shards")
        for old in (path, marked_path):
            release(rows.sparkSession, old)
        now, path = new, new_path
    return now, log


def _cell(values: np.ndarray, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(x)) for x in values.reshape(-1)]), at.cast("int") + 1)


def sharded(docs: DataFrame, n: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, law (``rows``), shard, slot, grown_shard (null): a row for each
    row of ``docs``.

    Links are equal texts; null texts are linked to nothing. Counts are at most one apart over all shards, which splits
    a group only where it is larger than a shard. Slots number a shard's rows from 0 without gaps. Rows that repeat a
    doc_id are rows of their own, told apart by their place among the rows of that doc_id. An empty table gives no rows.
    """
    raw = F.encode(F.col("text"), "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.when(F.col("text").isNotNull(), F.crc32(raw)).alias("text_crc32"),
        # 128 bits tell texts apart: the hub of equal texts.
        F.md5(raw).alias("text_key"),
    )
    rows, _ = stored(rows, "shard-rows")
    same = Window.partitionBy("doc_id", "text_key").orderBy("size")  # only whole repeats of a row share a task
    keyed = rows.withColumn("copy", F.row_number().over(same)).withColumn("id", F.struct("doc_id", "text_key", "copy"))
    found, _ = shards(keyed.select("id", "size", "text_crc32", F.col("text_key").alias("hub")), n)
    flat = found.select(F.col("id.doc_id").alias("doc_id"), F.col("id.text_key").alias("text_key"), F.col("id.copy").alias("copy"), "size", "text_crc32", "shard")
    slots = numbered(flat, ["shard"], ["doc_id", "text_key", "copy"], "slot")
    return slots.select("doc_id", "size", F.coalesce("text_crc32", F.lit(0)).cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
