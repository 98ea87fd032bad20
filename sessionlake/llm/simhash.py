"""Operator 5: SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is cut into blocks; within a block, bit ``i`` gets a vector ``m(i)`` of ``radius + 1`` bits, and each of
the ``2**(radius + 1) - 1`` non-zero vectors ``v`` gives the mask of bits with odd inner product ``<m(i), v>``. The
vectors of ``radius`` differing bits cannot span the whole space, so some ``v`` is orthogonal to all of them: that mask
drops every differing bit, and the pair meets in that table (Pagh, 2016). With ``k`` blocks of radius ``r`` every pair
within ``k * (r + 1) - 1`` bits meets, since some block then holds ``r`` of them at most.

Every meeting is settled by the exact distance. A bucket gives the edges of a spanning forest of its links instead of
all of its pairs: components are the same, and a bucket of n copies gives fewer than n rows. Buckets of more than
``chunk`` rows are dealt to several tasks as pairs of chunks, which together see every pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, pieces, plain, release, shuffle_partitions, stored, text_rows
from .components import connected_components
from .jaccard import kept_ids


@dataclass(frozen=True)
class Shape:
    """How fingerprints are made and linked. ``words``: shingle length; ``bits``: 64 or 128; ``reach``: largest
    distance of a link; ``blocks`` x ``radius``: the covering; ``chunk``: most rows of a bucket in one task; ``once``:
    count each distinct shingle once, as Jaccard similarity does."""

    words: int = 4
    bits: int = 64
    reach: int = 4
    blocks: int = 1
    radius: int = 4
    chunk: int = 8192
    seed: int = 42
    once: bool = False

    def __post_init__(self) -> None:
        if self.bits not in (64, 128) or self.bits % self.blocks or self.bits // self.blocks > 64:
            raise ValueError("bits must be 64 or 128, in equal blocks of at most 64")


#: Five words, each distinct shingle once, as Jaccard similarity counts them. Links reach as far as the covering
#: guarantees, 9 of 128 bits, and blocks are wide, so that few unrelated texts meet. No affordable radius is a similarity:
#: at Jaccard 0.8 the bits of two fingerprints differ with probability acos(2 J / (1 + J)) / pi = 0.151 each. So
#: :func:`near_duplicates_removed` checks every link and gets pairs further apart from an index of prefixes.
NEAR = Shape(words=5, bits=128, reach=9, blocks=2, radius=4, once=True)


def masks(bits: int, radius: int) -> np.ndarray:
    """The covering's masks over ``bits`` bits, as unsigned 64-bit words. ``m(i)`` runs through the non-zero vectors,
    so each mask keeps about half of the bits."""
    size = (1 << (radius + 1)) - 1
    m = [i % size + 1 for i in range(bits)]
    return np.array([sum(1 << i for i in range(bits) if (m[i] & v).bit_count() & 1) for v in range(1, size + 1)], dtype=np.uint64)


def fingerprint(text: str | None, shape: Shape = Shape()) -> np.ndarray:
    """The fingerprint's 64-bit words, least significant first. Only A-Z are lower-cased; words end at ASCII white
    space; repeats count; a text of fewer words is one shingle, one without words gives zero."""
    words = (text or "").encode().lower().split()
    wide = shape.bits // 64
    if not words:
        return np.zeros(wide, dtype=np.uint64)
    n = min(shape.words, len(words))
    buffer = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(buffer, dtype=np.uint8) == 32)
    starts = np.concatenate(([0], spaces + 1))[: len(words) - n + 1].tolist()
    ends = np.concatenate((spaces, [len(buffer)]))[n - 1 :].tolist()
    if wide == 1:
        hashes = np.fromiter((xxhash.xxh64_intdigest(buffer[a:b], shape.seed) for a, b in zip(starts, ends)), dtype=np.uint64, count=len(starts))
    else:
        hashes = np.frombuffer(b"".join([xxhash.xxh128_digest(buffer[a:b], shape.seed) for a, b in zip(starts, ends)]), dtype=np.uint64)
    rows = hashes.reshape(-1, wide)
    if shape.once:  # the low word tells shingles apart
        rows = rows[np.unique(rows[:, 0], return_index=True)[1]]
    return majority(rows)


def majority(rows: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the rows of 64-bit words; none without rows."""
    wide = rows.shape[1]
    ones = np.zeros(64 * wide, dtype=np.int64)
    for i in range(0, len(rows), 65536):  # bounded memory for very long texts
        part = np.ascontiguousarray(rows[i : i + 65536]).view(np.uint8).reshape(-1, 8 * wide)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(rows), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """doc_id, w0 (and w1 for 128 bits): a row for each row of ``docs``; null text counts as empty."""
    wide = shape.bits // 64

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames):
            words = np.array([fingerprint(t, shape) for t in frame["text"]], dtype=np.uint64).reshape(len(frame), wide).view(np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy()} | {f"w{k}": words[:, k] for k in range(wide)})

    return text_rows(docs).mapInPandas(run, "doc_id long, " + ", ".join(f"w{k} long" for k in range(wide)))


def _near(one: np.ndarray, many: np.ndarray, reach: int) -> np.ndarray:
    return np.bitwise_count(many ^ one).sum(axis=1) <= reach


def forest(points: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among ``points`` (rows of 64-bit words). Breadth first, so each point
    is compared only with those not reached yet."""
    edges, rest = [], np.arange(len(points))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            hit = _near(points[at], points[rest], reach)
            if hit.any():
                found = rest[hit].tolist()
                rest = rest[~hit]
                edges += [(at, x) for x in found]
                queue += found
    return edges


def stars(edges: np.ndarray) -> np.ndarray:
    """Edges (rows: two points) made canonical: from the least point of each component to each of its others. Whichever
    of a group's buckets give them, equal parts of a group give equal edges, and repeats can be dropped."""
    half = edges.shape[1] // 2
    points = np.concatenate((edges[:, :half], edges[:, half:]))
    order = np.lexsort(points.T[::-1])
    ranked = points[order]
    new = np.concatenate(([True], (ranked[1:] != ranked[:-1]).any(axis=1)))
    number = np.empty(len(points), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    distinct = ranked[new]
    a, b = number[: len(edges)], number[len(edges) :]
    root = np.arange(len(distinct))
    while True:
        least = np.minimum(root[a], root[b])
        was = root.copy()
        for end in (a, b):
            np.minimum.at(root, root[end], least)  # the roots themselves are joined
        root = np.minimum(root, root[root])
        if (root == was).all():
            break
    leaf = np.flatnonzero(root != np.arange(len(distinct)))
    return np.concatenate((distinct[root[leaf]], distinct[leaf]), axis=1)


def _bucket_pairs(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, reach: int, small: int = 64) -> list[np.ndarray]:
    """Links within each bucket, the rows from a start to an end of ``body``: all buckets of up to ``small`` rows at
    once, each row against the one k places on, k by k; larger ones breadth first."""
    found, size = [], ends - starts
    few = (size > 1) & (size <= small)
    row = np.repeat(starts[few], size[few]) + np.arange(int(size[few].sum())) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
    end = np.repeat(ends[few], size[few])
    for k in range(1, small):
        inside = row + k < end
        row, end = row[inside], end[inside]
        if not len(row):
            break
        x, y = body[row], body[row + k]
        hit = np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=1) <= reach
        if hit.any():
            found.append(np.concatenate((x[hit], y[hit]), axis=1))
    for a, b in zip(starts[size > small].tolist(), ends[size > small].tolist()):
        points = np.ascontiguousarray(body[a:b])
        if edges := forest(points.view(np.uint64), reach):
            e = np.array(edges)
            found.append(np.concatenate((points[e[:, 0]], points[e[:, 1]]), axis=1))
    return found


def _keys(points: np.ndarray, shape: Shape) -> tuple[np.ndarray, int]:
    """For each point and table the bucket's key: 64 bits of a mixed (table, masked bits)."""
    width = shape.bits // shape.blocks
    out = []
    for block in range(shape.blocks):
        at = block * width
        word = points[:, at // 64]
        part = (word >> np.uint64(at % 64)) & np.uint64((1 << width) - 1)
        for k, mask in enumerate(masks(width, shape.radius)):
            table = np.uint64((block * 1024 + k + 1) * 0xD6E8FEB86659FD93 % 2**64)
            x = (part & mask) * np.uint64(0x9E3779B97F4A7C15) ^ table
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out.append(x ^ (x >> np.uint64(29)))
    return np.stack(out, axis=1), len(out)


def _tables(points: DataFrame, shape: Shape) -> DataFrame:
    """key and the point's words: a row for each point and table."""
    cols = [c for c in points.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 20_000):
                signed = frame.iloc[i : i + 20_000][cols].to_numpy(dtype=np.int64)
                keys, n = _keys(signed.view(np.uint64), shape)
                yield pd.DataFrame({"key": keys.view(np.int64).reshape(-1)} | {c: np.repeat(signed[:, k], n) for k, c in enumerate(cols)})

    return points.mapInPandas(run, "key long, " + ", ".join(f"{c} long" for c in cols))


def _bucket_edges(rows: DataFrame, group: list[str], cols: list[str], reach: int) -> DataFrame:
    """Forest edges within each group; rows of a group are neighbours in their sorted partition."""

    named = [f"{s}{k}" for s in "ab" for k in range(len(cols))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: np.ndarray | None = None

        def solved(values: np.ndarray, bounds: np.ndarray) -> Iterator[pd.DataFrame]:
            found = _bucket_pairs(np.ascontiguousarray(values[:, len(group) :]), bounds[:-1], bounds[1:], reach)
            if found:
                yield pd.DataFrame(stars(np.concatenate(found)), columns=named)

        for frame in frames:
            values = frame[group + cols].to_numpy(dtype=np.int64)
            if held is not None:
                values = np.concatenate((held, values))
            if not len(values):
                continue
            new = np.flatnonzero((values[1:, : len(group)] != values[:-1, : len(group)]).any(axis=1)) + 1
            bounds = np.concatenate(([0], new))
            held = values[bounds[-1] :]  # the last bucket may go on in the next frame
            yield from solved(values, bounds)
        if held is not None:
            yield from solved(held, np.array([0, len(held)]))

    schema = ", ".join(f"{s}{k} long" for s in "ab" for k in range(len(cols)))
    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, *group).sortWithinPartitions(*group).mapInPandas(run, schema)


def _hot(points: DataFrame, shape: Shape) -> DataFrame:
    """key, rows: the buckets that may hold more than ``shape.chunk`` points.

    Of ``n`` points in batches, a bucket with more than ``chunk`` has in some batch of ``m`` at least ``m * chunk / n``;
    only such counts leave their task. The sum falls short of a bucket's size by about ``chunk`` at most. It decides
    how a bucket is dealt to tasks, never what is found in it.
    """
    n = max(1, points.count())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, _ = _keys(frame.to_numpy(dtype=np.int64).view(np.uint64), shape)
            for column in keys.T:
                key, count = np.unique(column, return_counts=True)
                many = count >= max(2, len(frame) * shape.chunk // n)
                yield pd.DataFrame({"key": key[many].view(np.int64), "rows": count[many]})

    found = points.mapInPandas(run, "key long, rows long")
    return found.groupBy("key").agg(F.sum("rows").alias("rows")).where(F.col("rows") >= shape.chunk)


def links(points: DataFrame, shape: Shape) -> DataFrame:
    """Edges (a0.., b0..) whose components are those of all pairs within ``shape.reach`` that meet in a table.
    ``points``: distinct fingerprints, columns w0 (and w1)."""
    spark = points.sparkSession
    cols = points.columns
    rows = _tables(points, shape)
    hot, hot_path = stored(_hot(points, shape), "simhash-hot")
    if hot.isEmpty():
        release(spark, hot_path)
        return _bucket_edges(rows, ["key"], cols, shape.reach).distinct()
    chunks = (F.floor(F.col("rows") / shape.chunk) + 1).cast("int")
    marked = rows.join(hot.withColumn("chunks", chunks).drop("rows"), "key", "left")
    cool = marked.where("chunks is null").select("key", *cols)
    # A row of chunk c goes to each pair of chunks that holds c.
    own = marked.where("chunks is not null").withColumn("c", F.pmod(F.xxhash64(*cols), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = own.withColumn("o", other).select("key", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), *cols)
    pairs = _bucket_edges(dealt, ["key", "lo", "hi"], cols, shape.reach)
    return _bucket_edges(cool, ["key"], cols, shape.reach).union(pairs).distinct()


def components(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """doc_id, w0 (w1), component_id: a row for each row of ``docs``.

    component_id is the least doc_id that links lead to, the row's own included. Rows with equal fingerprints are
    linked, those without words (fingerprint zero, null texts too) among them. Rows without doc_id keep a fingerprint
    and take part in links; a component of such rows alone has a null component_id. An empty table gives no rows.
    """
    cols = [f"w{k}" for k in range(shape.bits // 64)]
    prints, _ = stored(fingerprints(docs, shape), "simhash-prints")
    points, points_path = stored(prints.groupBy(*cols).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "simhash-points")
    edges = links(points.select(*cols), shape)
    key = (lambda side: F.col(f"{side}0")) if len(cols) == 1 else (lambda side: F.struct(*[F.col(f"{side}{k}").alias(f"w{k}") for k in range(len(cols))]))
    roots, _ = connected_components(edges.select(key("a").alias("a"), key("b").alias("b")))
    node = F.col("w0") if len(cols) == 1 else F.struct(*[F.col(c) for c in cols])
    labelled = points.withColumn("node", node).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("points"))
    linked = join_groups(labelled, least, "root", "points", points.count())
    # One fingerprint may be that of a third of all rows: copies, or texts without words.
    named = linked.select(F.col("node").alias("_node"), "copies", "component_id")
    return join_groups(prints.withColumn("_node", node), named, "_node", "copies", prints.count()).select("doc_id", *cols, "component_id")


def near_links(sets: DataFrame, shape: Shape = NEAR) -> DataFrame:
    """Edges (a0, a1, b0, b1) whose components are those of all pairs of ``sets`` (h0, h1: its name; w0, w1: its
    fingerprint) within ``shape.reach`` bits, by the covering tables."""
    print_ = F.struct(*[f"w{k}" for k in range(shape.bits // 64)])
    sets = sets.select(F.struct("h0", "h1").alias("name"), print_.alias("print"))
    known, _ = stored(sets.groupBy("print").agg(F.min("name").alias("first"), F.count("*").alias("sets")), "simhash-known")
    edges = links(known.select("print.*"), shape)
    end = lambda s: known.select(F.col("print").alias(f"_{s}"), F.col("first").alias(s))
    side = lambda s: F.struct(*[F.col(f"{s}{k}").alias(f"w{k}") for k in range(shape.bits // 64)])
    far = edges.select(side("a").alias("_a"), side("b").alias("_b")).join(end("a"), "_a").join(end("b"), "_b").select("a", "b")
    same = join_groups(sets, known.where("sets > 1"), "print", "sets", sets.count()).where("first <> name").select(F.col("first").alias("a"), F.col("name").alias("b"))
    return far.union(same).select(*[F.col(f"{s}.h{k}").alias(f"{s}{k}") for s in "ab" for k in (0, 1)])


def near_duplicates_removed(docs: DataFrame, shape: Shape = NEAR) -> DataFrame:
    """``docs`` without all but one document of each component: the one with the least doc_id. A link is a Jaccard
    similarity of 0.8 or more of the shingle sets, decided exactly: on what the covering tables of ``shape`` link, and on
    what only an index of prefixes can find, since similar texts may be further apart than the tables reach. Rows that repeat
    a doc_id count once. A row without doc_id is known by its text, and goes before one that has an id: of such rows with
    equal texts one stays, and none where a row with an id is a near duplicate."""
    columns, name = plain(docs), "_row_key"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    # Above all ids of tables that number their rows; a clash of a hash with an id has a chance of rows / 2 ** 62.
    by_text = F.xxhash64(F.col("text").cast("string")).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    named = docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), by_text).alias(name))
    keep = kept_ids(named.select(F.col(name).alias("doc_id"), "text"), shape.words, shape.chunk, near=lambda sets: near_links(sets, shape)).toDF(name)
    kept = named.join(keep, name, "left_semi")
    repeated = named.groupBy(name).count().where("count > 1")
    if repeated.isEmpty():
        return kept.select(columns)
    twice, _ = stored(repeated.select(name), "simhash-repeated")
    once = kept.join(twice, name, "left_anti").select(columns)
    again = kept.join(twice, name, "left_semi").select(name, F.struct(columns).alias("row"))
    # The one whose hash over text and all columns is least: the same in any run.
    seen = again.groupBy(name).agg(F.min_by("row", F.struct(F.xxhash64("row.text"), F.xxhash64(F.to_json("row")))).alias("row"))
    return once.union(seen.select([F.col("row")[c].alias(c) for c in docs.columns]))
