"""Operator 13: a Merkle manifest of a dataset, with proofs for every row by its ancestors' preimages.

A leaf is the hash of a row. The leaves of a group (a language) stand in order, runs of two become their hash, level by
level, until one node remains; the groups' nodes, in order of the groups, go on in the same way up to the root.

A parent's *preimage* is its children's hashes, concatenated: what it is the hash of. Levels are built six at a time:
64 nodes that lie side by side are a block, and a block's row keeps the preimages of all its parents. The blocks' own
nodes are the next six levels' leaves, so the work above the leaves is a sixty-fourth each time. From the top down each
block is joined with the block above and so learns the preimages of all its ancestors; the leaves are joined once, with
their block. In an ancestor's preimage a node has a slot of 64 characters, told by a bit of its number: without this slot
the preimage is the siblings, with a replacement in it the parent can be hashed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, stored
from .ranks import ranked

_LEVELS = 6  # a block holds 2 ** 6 nodes
_HEX = 64


def field(value: Column) -> Column:
    """A value so that concatenated fields can't be read in two ways: ``-`` for null, else bytes, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def _parents(hashes: Column) -> Column:
    """The preimages of the next level: runs of two; the last may be one."""
    return F.transform(F.sequence(F.lit(1), F.size(hashes), F.lit(2)), lambda i: F.concat_ws("", F.slice(hashes, i, F.lit(2))))


def height(n: Column) -> Column:
    """Levels above ``n`` nodes."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def blocks(nodes: DataFrame) -> DataFrame:
    """Nodes (g, n nodes of g, at, hash) as blocks (g, n, block, hash, pre): ``pre`` lists the preimages of each level
    in the block. A group of no more nodes than a block has only the levels that it needs."""
    inside = F.bit_count(F.lit((1 << _LEVELS) - 1))
    rows = nodes.withColumn("block", F.shiftright("at", _LEVELS)).groupBy("g", "n", "block").agg(F.sort_array(F.collect_list(F.struct("at", "hash"))).alias("nodes"))
    rows = rows.select("g", "n", "block", F.least(height(F.col("n")), inside).alias("levels"), F.col("nodes.hash").alias("h0"))
    for k in range(_LEVELS):
        more = F.col("levels") > k
        rows = rows.withColumn(f"p{k + 1}", F.when(more, _parents(F.col(f"h{k}"))))
        rows = rows.withColumn(f"h{k + 1}", F.when(more, F.transform(f"p{k + 1}", lambda p: F.sha2(p, 256))).otherwise(F.col(f"h{k}")))
    return rows.select("g", "n", "block", F.col(f"h{_LEVELS}")[0].alias("hash"), F.filter(F.array(*[f"p{k + 1}" for k in range(_LEVELS)]), lambda p: p.isNotNull()).alias("pre"))


def _own(pre: Column, at: Column) -> Column:
    """Of a block's preimages those of the ancestors of node ``at``, lowest first."""
    inside = at.bitwiseAND((1 << _LEVELS) - 1).cast("int")
    return F.transform(pre, lambda level, k: F.get(level, F.call_function("shiftright", inside, k + 1)))


def tree(leaves: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """The trees over leaves (g, n, at, hash): for each group the lowest blocks (g, block, top, pre, up), ``top`` being
    the node that remains and ``up`` the preimages of the ancestors above the block. Also the scratch tables' paths."""
    paths: list[str] = []
    levels: list[DataFrame] = []
    nodes, width = leaves, 1 << _LEVELS
    while True:
        found, path = stored(blocks(nodes), name)
        levels.append(found)
        paths.append(path)
        over = found.where(F.col("n") > width)
        if over.isEmpty():
            break
        nodes = over.select("g", F.ceil(F.col("n") / width).cast("long").alias("n"), F.col("block").alias("at"), "hash")
    none = F.array().cast("array<string>")
    done: DataFrame | None = None
    for found in reversed(levels):
        last = found.where(F.col("n") <= width).select("g", "block", F.col("hash").alias("top"), "pre", none.alias("up"))
        if done is not None:
            above = done.select("g", F.col("block").alias("parent"), "top", F.col("pre").alias("above"), "up")
            below = found.where(F.col("n") > width).withColumn("parent", F.shiftright("block", _LEVELS)).join(above, ["g", "parent"])
            last = last.unionByName(below.select("g", "block", "top", "pre", F.concat(_own(F.col("above"), F.col("block")), "up").alias("up")))
        done, path = stored(last, name)
        paths.append(path)
    return done, paths


def excised(preimage: Column, slot: Column) -> Column:
    """The siblings: a preimage without the hash in ``slot``."""
    return F.concat(F.substring(preimage, F.lit(1), slot * _HEX), F.substring(preimage, slot * _HEX + _HEX + 1, F.lit(_HEX)))


def spliced(preimage: Column, slot: Column, own: Column) -> Column:
    """A preimage with ``own`` in ``slot``."""
    return F.concat(F.substring(preimage, F.lit(1), slot * _HEX), own, F.substring(preimage, slot * _HEX + _HEX + 1, F.lit(_HEX)))


def manifest(rows: DataFrame) -> DataFrame:
    """Rows (any columns, and g: the group, a string or null; id: what orders; leaf; changed: the leaf of a tampered
    row, null where it was not) with subroot, root, proof_sha256 (the hash of the siblings from leaf to root),
    folded_root (from the changed leaf, else the leaf, and the siblings) and verified.

    Leaves stand in order of id, nulls first, then of leaf; groups in order of their UTF-8 bytes, null first. Rows that
    repeat a leaf are leaves of their own. A group of one leaf is this leaf; an empty table has no rows."""
    kept = [f"`{c}`" for c in rows.columns]
    own = rows.withColumn("_g", F.coalesce(F.concat(F.lit("="), "g"), F.lit("")))
    leaves, leaf_path = ranked(own, "_g", ["id", "leaf"], "at", "n", "merkle-leaves")
    leaves, numbered_path = stored(leaves, "merkle-ranks")
    release(rows.sparkSession, leaf_path)
    low, scratch = tree(leaves.select(F.col("_g").alias("g"), "n", "at", F.col("leaf").alias("hash")), "merkle-blocks")
    tops = low.where("block = 0").select("g", "top", F.lit("all").alias("all"))
    groups, group_path = ranked(tops, "all", ["g"], "place", "groups", "merkle-groups")
    groups, place_path = stored(groups, "merkle-places")
    crown, more = tree(groups.select(F.col("all").alias("g"), F.col("groups").alias("n"), F.col("place").alias("at"), F.col("top").alias("hash")), "merkle-crown")
    heads = groups.withColumn("block", F.shiftright("place", _LEVELS)).join(crown.select(F.col("g").alias("all"), "block", F.col("top").alias("root"), "pre", "up"), ["all", "block"])
    heads = heads.select("g", "place", "root", F.concat(_own(F.col("pre"), F.col("place")), "up").alias("over"))
    low = low.join(heads, "g")
    joined = leaves.withColumn("block", F.shiftright("at", _LEVELS)).join(low.withColumnsRenamed({"g": "_g", "top": "subroot"}), ["_g", "block"])
    below = F.concat(_own(F.col("pre"), F.col("at")), F.col("up"))
    steps = F.concat(
        F.transform(below, lambda p, k: F.struct(p.alias("pre"), F.call_function("shiftright", F.col("at"), k).bitwiseAND(1).cast("int").alias("slot"))),
        F.transform(F.col("over"), lambda p, k: F.struct(p.alias("pre"), F.call_function("shiftright", F.col("place"), k).bitwiseAND(1).cast("int").alias("slot"))),
    )
    found = joined.select(*kept, "subroot", "root", steps.alias("_steps"))
    proof = F.sha2(F.concat_ws("", F.transform("_steps", lambda s: excised(s["pre"], s["slot"]))), 256)
    folded = F.aggregate("_steps", F.coalesce("changed", "leaf"), lambda own, s: F.sha2(spliced(s["pre"], s["slot"], own), 256))
    out, _ = stored(found.select(*kept, "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")), "merkle-manifest")
    for path in (numbered_path, group_path, place_path, *scratch, *more):
        release(rows.sparkSession, path)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def documents(docs: DataFrame, every: int = 7) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of ``docs`` (doc_id, source, lang, n_chars,
    text), grouped by lang. Rows where ``every`` divides the CRC-32 of the decimal doc_id are checked with n_chars one
    larger; a null stays, and so does a row without doc_id. Nulls are fields of their own kind, empty texts are not
    null; other columns play no part."""
    ids, n = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")
    parts = lambda n_chars: digest(ids, F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = (F.pmod(F.crc32(F.encode(ids.cast("string"), "UTF-8")), F.lit(every)) == 0) & n.isNotNull()
    rows = docs.select(ids.alias("id"), F.col("lang").cast("string").alias("g"), parts(n).alias("leaf"), F.when(tampered, parts(n + 1)).alias("changed"))
    return manifest(rows).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
