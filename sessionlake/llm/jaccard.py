"""Near duplicates by the exact Jaccard similarity of word shingles, 0.8 or more; no pair is lost.

A text is the set of its shingles' 64-bit hashes. Two sets of ``x`` and ``y`` members are similar if they share
``ceil(4 (x + y) / 9)``. With every set in one order, the first member that such a pair shares is among the first
``n - ceil(0.8 n) + 1`` of both (the prefix): an index of prefixes lets every such pair meet. Any order will do; ours has
what a sample finds common last, and else ascends. Two bounds drop pairs
that meet for nothing, neither of them a similar one: what can still be shared from the meeting on, and the distance of
two 256-bit parity maps, which the symmetric difference is never less than. Those maps are full for long texts, whose
pairs are tried once more on maps as long as the sets ask for. What is left joins sets to candidate groups, and within
a group all pairs are decided by counting what they share. A large group is decided in steps (:func:`similar`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, pieces, release, send, shuffle_partitions, stored, text_rows, trimmed
from .components import connected_components

MAP = 4  # words of a parity map
LONG = 800  # sizes of a pair, summed, from which maps of that length are full
BLANK = 720  # sets of more have an empty map: those similar to one have 4 / 5 as many, and a map of 256 bits refuses few such pairs
COLUMNS = ["h0", "h1", "at", *[f"s{k}" for k in range(MAP)]]
EDGE = ["a0", "a1", "b0", "b1", "ask"]


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles' hashes in ascending order. A-Z are lower-cased; words end at ASCII white space; a text of
    fewer words is one shingle, one without words has none."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    n = min(words, len(w))
    buffer = b" ".join(w)
    spaces = np.flatnonzero(np.frombuffer(buffer, dtype=np.uint8) == 32)
    starts = np.concatenate(([0], spaces + 1))[: len(w) - n + 1].tolist()
    ends = np.concatenate((spaces, [len(buffer)]))[n - 1 :].tolist()
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(buffer[a:b]) for a, b in zip(starts, ends)), dtype=np.uint64, count=len(starts)))


def _name(own: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh128_digest(own.tobytes()), dtype=np.int64).tolist())


def _fingerprint(own: np.ndarray) -> np.ndarray:
    """The set's SimHash of 128 bits: half from the members' hashes, half from these mixed once more."""
    from .simhash import majority

    x = (own ^ (own >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return majority(np.stack((own, x ^ (x >> np.uint64(31))), axis=1)).view(np.int64)


def _parity(own: np.ndarray, size: int = 64 * MAP) -> np.ndarray:
    odd = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _long(own: np.ndarray) -> bytes:
    """A parity map of 2 to 4 bits a member; empty where the short one does."""
    return _parity(own, 1 << (2 * len(own) - 1).bit_length()).tobytes() if len(own) > LONG // 3 else b""


def _apart(one: bytes, two: bytes) -> int:
    """The distance of two long maps; the longer is folded, which gives the map of its set at the other's length."""
    x, y = sorted((np.frombuffer(one, dtype=np.uint64), np.frombuffer(two, dtype=np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum()) if len(x) else 0


def common(docs: DataFrame, words: int, sample: int = 5000, share: int = 16, least: int = 8, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Members that at least ``least`` of a sample have, in ascending order, and the rank of each, rarest first. They come
    last in the order of all sets; which ones they are decides what meets for nothing, never what is found. The sample is a
    document in ``share``, or about ``sample`` documents of fewer: with a fixed number of them a passage that a thousandth
    of all documents hold would go unseen, and its bucket would grow with the table. Of more than ``most`` members
    those of the least counts are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames, 4_000_000):
            own, n = np.unique(np.concatenate([shingles(t, words) for t in frame["text"]]), return_counts=True)
            yield pd.DataFrame({"key": own.view(np.int64), "n": n})

    every = max(1, min(share, docs.count() // sample))
    some = text_rows(docs).where(F.pmod(F.xxhash64("doc_id", F.lit("common")), F.lit(every)) == 0)
    counts = some.mapInPandas(trimmed(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counts, path = stored(counts, "jaccard-common")
    held, from_ = 0, least
    for n, keys in counts.groupBy("n").count().orderBy(F.desc("n")).collect():  # counts repeat: few rows
        held += keys
        if held > most:
            from_ = n + 1
            break
    found = counts.where(F.col("n") >= from_).toArrow()  # bounded
    release(docs.sparkSession, path)
    key, n = (found.column(c).to_numpy() for c in ("key", "n"))
    key = key.view(np.uint64)
    order = np.argsort(key)
    rank = np.empty(len(key), dtype=np.int32)
    rank[np.lexsort((key, n))] = np.arange(len(key), dtype=np.int32)
    return key[order], rank[order]


def _prefix(own: np.ndarray, last: np.ndarray, rank: np.ndarray) -> np.ndarray:
    if len(last):
        place = np.minimum(np.searchsorted(last, own), len(last) - 1)
        late = last[place] == own
        own = np.concatenate((own[~late], own[late][np.argsort(rank[place[late]])]))
    return own[: len(own) - -(-4 * len(own) // 5) + 1]


def prints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, the name of the text's set, its size, its fingerprint, its parity map and its prefix."""

    sent = send(docs.sparkSession, common(docs, words))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames):
            sets = [shingles(t, words) for t in frame["text"]]
            names = np.array([_name(s) for s in sets], dtype=np.int64).reshape(-1, 2)
            maps = np.array([_parity(s if len(s) <= BLANK else s[:0]) for s in sets], dtype=np.int64).reshape(-1, MAP)
            bits = np.array([_fingerprint(s) for s in sets], dtype=np.int64).reshape(-1, 2)
            sizes = [len(s) for s in sets]
            prefix = [_prefix(s, *sent.value).tobytes() for s in sets]
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "h0": names[:, 0], "h1": names[:, 1], "n": sizes, "w0": bits[:, 0], "w1": bits[:, 1]} | {f"s{k}": maps[:, k] for k in range(MAP)} | {"prefix": prefix, "long": [_long(s) for s in sets]})

    return text_rows(docs).mapInPandas(trimmed(run), "doc_id long, h0 long, h1 long, n long, w0 long, w1 long, " + "".join(f"s{k} long, " for k in range(MAP)) + "prefix binary, long binary")


def _index(points: DataFrame) -> DataFrame:
    """key and COLUMNS (at: size and place, 32 bits each): a row for each member of each prefix."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 2000):
                part = frame.iloc[i : i + 2000]
                own = [np.frombuffer(p, dtype=np.int64) for p in part["prefix"]]
                many = np.array([len(x) for x in own], dtype=np.int64)
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                cols = {c: np.repeat(part[c].to_numpy(), many) for c in ("h0", "h1", "n", *COLUMNS[3:])}
                yield pd.DataFrame({"key": np.concatenate(own), "h0": cols["h0"], "h1": cols["h1"], "at": cols["n"] << 32 | place} | {c: cols[c] for c in COLUMNS[3:]})

    return points.select("h0", "h1", "n", *COLUMNS[3:], "prefix").mapInPandas(trimmed(run), "key long, " + ", ".join(f"{c} long" for c in COLUMNS))


def may_link(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of COLUMNS that meet at a member can be similar, if it is the first that they share."""
    nx, ny = x[..., 2] >> 32, y[..., 2] >> 32
    need = -(-4 * (nx + ny) // 9)
    left = np.minimum(nx - (x[..., 2] & 0xFFFFFFFF), ny - (y[..., 2] & 0xFFFFFFFF))
    apart = np.bitwise_count((x[..., 3:] ^ y[..., 3:]).view(np.uint64)).sum(axis=-1)
    blank = 5 * (nx + ny) > 9 * BLANK  # one of them may have no map
    return (left >= need) & (blank | (apart <= nx + ny - 2 * need))


def _bucket_stars(rows: np.ndarray) -> list[tuple[int, int]]:
    """Of each component of what may link: its first row with each other one."""
    edges, rest = [], np.arange(len(rows))
    while len(rest) > 1:
        root, rest = int(rest[0]), rest[1:]
        queue = [root]
        while queue and len(rest):
            hit = may_link(rows[queue.pop()], rows[rest])
            if hit.any():
                found = rest[hit].tolist()
                rest = rest[~hit]
                edges += [(root, x) for x in found]
                queue += found
    return edges


def _meetings(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, small: int = 256) -> Iterator[np.ndarray]:
    """Names of rows that meet in a bucket and may link, and 1 where the long maps are to be asked: all pairs of small
    buckets, stars of larger ones, whose links are taken as they are. Rows of a bucket are in order of their names."""
    size = ends - starts
    few = (size > 1) & (size <= small)
    row = np.repeat(starts[few], size[few]) + np.arange(int(size[few].sum())) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
    end = np.repeat(ends[few], size[few])
    for k in range(1, small):
        inside = row + k < end
        row, end = row[inside], end[inside]
        if not len(row):
            break
        x, y = body[row], body[row + k]
        hit = may_link(x, y)
        x, y = x[hit], y[hit]
        ask = (x[:, 2] >> 32) + (y[:, 2] >> 32) > LONG
        yield np.concatenate((x[:, :2], y[:, :2], ask[:, None]), axis=1)
    for a, b in zip(starts[size > small].tolist(), ends[size > small].tolist()):
        if edges := _bucket_stars(body[a:b]):
            e = np.array(edges) + a
            yield np.concatenate((body[e[:, 0], :2], body[e[:, 1], :2], np.zeros((len(e), 1), dtype=np.int64)), axis=1)


def _met(rows: DataFrame, group: list[str]) -> DataFrame:
    from .simhash import stars

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((0, len(group) + len(COLUMNS)), dtype=np.int64)

        def reduced(found: list[np.ndarray]) -> list[np.ndarray]:
            every = np.concatenate(found)
            sure, ask = every[every[:, 4] == 0, :4], every[every[:, 4] == 1]
            if len(sure):
                sure = stars(sure)
            return [np.pad(sure, ((0, 0), (0, 1))), ask]

        def solved(values: np.ndarray, bounds: np.ndarray, most: int = 100_000) -> Iterator[pd.DataFrame]:
            found, many = [], 0
            for part in _meetings(np.ascontiguousarray(values[:, len(group) :]), bounds[:-1], bounds[1:]):
                found.append(part)
                many += len(part)
                if many > most:  # sure links shrink to stars; those to be asked leave at once
                    sure, ask = reduced(found)
                    yield pd.DataFrame(ask, columns=EDGE)
                    found, many = [sure], 0
            if found:
                yield pd.DataFrame(np.concatenate(reduced(found)), columns=EDGE)

        for frame in frames:
            values = np.concatenate((held, frame[group + COLUMNS].to_numpy(dtype=np.int64)))
            if not len(values):
                continue
            new = np.flatnonzero((values[1:, : len(group)] != values[:-1, : len(group)]).any(axis=1)) + 1
            bounds = np.concatenate(([0], new))
            held = values[bounds[-1] :]  # the last bucket may go on in the next frame
            yield from solved(values, bounds)
        if len(held):
            yield from solved(held, np.array([0, len(held)]))

    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, *group).sortWithinPartitions(*group, "h0", "h1").mapInPandas(trimmed(run), ", ".join(f"{c} long" for c in EDGE))


def _asked(met: DataFrame, points: DataFrame) -> DataFrame:
    """Edges without the pairs that the long maps refuse."""
    met, _ = stored(met.distinct(), "jaccard-met")
    side = lambda s: points.where("long <> x''").select(F.col("h0").alias(f"{s}0"), F.col("h1").alias(f"{s}1"), F.col("n").alias(f"{s}n"), F.col("long").alias(f"{s}l"))
    ask = met.where("ask = 1").drop("ask")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            total = frame["an"] + frame["bn"]
            apart = np.array([_apart(x, y) for x, y in zip(frame["al"], frame["bl"])], dtype=np.int64)
            yield frame[(total + 2 * (-4 * total // 9)).to_numpy() >= apart][["a0", "a1", "b0", "b1"]]

    tried = ask.join(side("a"), ["a0", "a1"]).join(side("b"), ["b0", "b1"]).mapInPandas(trimmed(run), "a0 long, a1 long, b0 long, b1 long")
    return met.where("ask = 0").drop("ask").union(tried)


def candidates(points: DataFrame, chunk: int) -> DataFrame:
    """Edges (a0, a1, b0, b1) whose components hold every similar pair. Buckets of more than ``chunk`` rows are dealt
    as pairs of chunks."""
    rows = _index(points)
    total = max(1, points.count())

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # A bucket of more than chunk of all points has its share in some batch (a point is in a bucket once).
            keys = [np.frombuffer(p, dtype=np.int64) for p in frame["prefix"]]
            key, many = np.unique(np.concatenate([*keys, np.zeros(0, dtype=np.int64)]), return_counts=True)
            large = many >= max(2, len(frame) * chunk // total)
            yield pd.DataFrame({"key": key[large], "rows": many[large]})

    if total <= chunk:
        return _asked(_met(rows, ["key"]), points)
    found = points.select("prefix").mapInPandas(trimmed(count), "key long, rows long").groupBy("key").agg(F.sum("rows").alias("rows"))
    hot, path = stored(found.where(F.col("rows") >= chunk), "jaccard-hot")
    if hot.isEmpty():
        release(points.sparkSession, path)
        return _asked(_met(rows, ["key"]), points)
    marked = rows.join(hot.select("key", (F.floor(F.col("rows") / chunk) + 1).cast("int").alias("chunks")), "key", "left")
    cool = marked.where("chunks is null").select("key", *COLUMNS)
    own = marked.where("chunks is not null").withColumn("c", F.pmod(F.xxhash64("h0", "h1"), F.col("chunks")).cast("int"))
    dealt = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("key", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), *COLUMNS)
    return _asked(_met(cool, ["key"]).union(_met(dealt, ["key", "lo", "hi"])), points)


def exact_stars(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """For each component of the similar pairs among the sets its first set with each other one. Breadth first: what a
    set shares with all that are not reached yet is counted by an inverted list of those."""
    m, size = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    token, start = token.reshape(-1), np.cumsum(size) - size
    order = np.argsort(token, kind="stable")
    listed, holder = token[order], np.repeat(np.arange(m), size)[order]
    first = np.searchsorted(listed, np.arange(token.max(initial=-1) + 2))
    away, left, kept = np.ones(m, dtype=bool), m, m
    edges: list[tuple[int, int]] = []
    for root in range(m):
        if not away[root]:
            continue
        away[root], left = False, left - 1
        queue = [root]
        while queue and left:
            at = queue.pop()
            if left * 2 < kept:
                still = away[holder]
                listed, holder, kept = listed[still], holder[still], left
                first = np.searchsorted(listed, np.arange(len(first)))
            own = token[start[at] : start[at] + size[at]]
            many = first[own + 1] - first[own]
            where = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            shared = np.bincount(holder[where], minlength=m)
            hit = np.flatnonzero(away & (9 * shared >= 4 * (size[at] + size)))
            away[hit], left = False, left - len(hit)
            edges += [(root, x) for x in hit.tolist()]
            queue += hit.tolist()
    return edges


def _point(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("h0"), F.col(b).alias("h1"))


def _decided(docs: DataFrame, dealt: DataFrame, words: int) -> DataFrame:
    """Edges whose components are those of all similar pairs among the sets (h0, h1; least: a document that has it) of
    each task (root, lo, hi) of ``dealt``."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames, 2_000_000):
            sets = [shingles(t, words) for t in frame["text"]]
            names = np.array([_name(s) for s in sets], dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame({"h0": names[:, 0], "h1": names[:, 1], "own": [s.tobytes() for s in sets]})

    texts = text_rows(docs).join(dealt.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = texts.mapInPandas(trimmed(read), "h0 long, h1 long, own binary").groupBy("h0", "h1").agg(F.first("own").alias("own"))
    dealt = dealt.select("h0", "h1", F.col("root.h0").alias("r0"), F.col("root.h1").alias("r1"), "lo", "hi")
    group = ["r0", "r1", "lo", "hi"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: list[tuple[int, int]] = []
        sets: list[np.ndarray] = []
        now = None

        def solved() -> Iterator[pd.DataFrame]:
            if edges := exact_stars(sets) if len(sets) > 1 else []:
                yield pd.DataFrame([(*names[a], *names[b]) for a, b in edges], columns=["a0", "a1", "b0", "b1"])

        for frame in frames:
            for r0, r1, lo, hi, h0, h1, own in frame[[*group, "h0", "h1", "own"]].itertuples(index=False, name=None):
                if (r0, r1, lo, hi) != now:
                    yield from solved()
                    names, sets, now = [], [], (r0, r1, lo, hi)
                names.append((h0, h1))
                sets.append(np.frombuffer(own, dtype=np.uint64))
        yield from solved()

    ready = dealt.join(sets, ["h0", "h1"]).repartition(shuffle_partitions(docs.sparkSession), *group).sortWithinPartitions(*group, "h0", "h1")
    return ready.mapInPandas(trimmed(run), "a0 long, a1 long, b0 long, b1 long").distinct()


def _chunk(chunks: Column, turn: int = 0) -> Column:
    return F.pmod(F.xxhash64("h0", "h1", F.lit(turn)), chunks).cast("int")


def _parts(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """``sets`` with the least set (``part``) of those that ``edges`` link each with."""
    part, _ = connected_components(edges.select(_point("a0", "a1").alias("a"), _point("b0", "b1").alias("b")))
    name = _point("h0", "h1")
    return stored(sets.withColumn("node", name).join(part.withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node")).drop("node"), "jaccard-parts")[0]


def _some(parts: DataFrame, total: int, turn: int) -> DataFrame:
    """The first and about four others of the sets of each part; others at each turn."""
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"), F.ceil(F.count("*") / 4).alias("every"))
    lot = F.pmod(F.xxhash64("h1", "h0", F.lit(turn)), F.col("every"))
    return join_groups(parts, sizes, "part", "size", total).where((lot == 0) | (F.col("part") == _point("h0", "h1"))).drop("every")


def _across(parts: DataFrame, load: int) -> DataFrame:
    """Tasks that hold every pair of sets of a group (root) but those within its largest part, which are linked already:
    the chunks of that part, each with each chunk of the rest, and the chunks of the rest with each other."""
    by_part = parts.groupBy("root", "part").agg(F.sum("n").alias("sum"))
    main = by_part.groupBy("root").agg(F.max(F.struct("sum", "part")).alias("top"), F.sum("sum").alias("all"))
    count = lambda n: F.ceil(n / load).cast("int")
    main = main.select("root", F.col("top.part").alias("main"), count(F.col("top.sum")).alias("m"), count(F.col("all") - F.col("top.sum")).alias("o")).where("o > 0")
    own = parts.join(F.broadcast(main), "root").withColumn("inside", F.col("part") == F.col("main"))  # few: each holds much text
    own = own.withColumn("c", _chunk(F.when(F.col("inside"), F.col("m")).otherwise(F.col("o"))))
    task = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    others = F.filter(F.sequence(F.lit(0), F.col("o") - 1), lambda k: k != F.col("c"))
    rest = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: task(i, F.col("c"))),
        F.transform(others, lambda k: task(F.col("m") + F.least(F.col("c"), k), F.greatest(F.col("c"), k))),
    )
    tasks = F.when(F.col("inside"), F.transform(F.sequence(F.lit(0), F.col("o") - 1), lambda j: task(F.col("c"), j))).otherwise(rest)
    return own.withColumn("t", F.explode(tasks)).select("h0", "h1", "least", "root", "t.lo", "t.hi")


def similar(docs: DataFrame, points: DataFrame, edges: DataFrame, words: int, load: int) -> DataFrame:
    """Edges whose components are those of all pairs of similarity 0.8 or more within the components of ``edges``.
    ``load``: shingles of a chunk.

    A group of more is decided in three steps, so that a set of many copies goes to a few tasks instead of one for each
    pair of chunks: each chunk by itself; some sets of each part that this links, while parts come together; then all
    pairs but those within the group's largest part."""
    roots, _ = connected_components(edges.select(_point("a0", "a1").alias("a"), _point("b0", "b1").alias("b")))
    grouped, _ = stored(roots.join(points.select(_point("h0", "h1").alias("node"), "n", "least"), "node").select("node.*", "root", "n", "least"), "jaccard-grouped")
    large, _ = stored(grouped.groupBy("root").agg(F.sum("n").alias("sum")).where(F.col("sum") > load), "jaccard-large")
    chunks = large.select("root", F.ceil(F.col("sum") / load).cast("int").alias("chunks"))  # few: each holds much text
    marked = grouped.join(F.broadcast(chunks), "root", "left")
    dealt = marked.withColumn("lo", _chunk(F.coalesce("chunks", F.lit(1)))).withColumn("hi", F.col("lo")).drop("chunks")
    found = _decided(docs, dealt, words)
    if large.isEmpty():
        return found
    found, _ = stored(found, "jaccard-found")
    parts = _parts(dealt.join(F.broadcast(large.select("root")), "root", "left_semi").drop("lo", "hi"), found)
    many, total = parts.select("part").distinct().count(), parts.count()
    for turn in range(8):  # more would change no result, only what is left to the last step
        if many == large.count():
            break
        few = _some(parts, total, turn)
        sums = few.groupBy("root").agg(F.ceil(F.sum("n") / load).cast("int").alias("chunks"))
        between = few.join(F.broadcast(sums), "root").withColumn("lo", _chunk(F.col("chunks"), turn)).withColumn("hi", F.col("lo"))
        found, _ = stored(found.union(_decided(docs, between, words)), "jaccard-found")
        parts = _parts(parts.drop("part"), found)
        before, many = many, parts.select("part").distinct().count()
        if many == before:
            break
    return found.union(_decided(docs, _across(parts, load), words))


def kept_ids(docs: DataFrame, words: int = 5, chunk: int = 8192, load: int = 1_000_000, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id: the least of each component of similar documents. Rows need a doc_id; texts with equal sets, those without
    words among them, are linked. ``near``: gives candidate edges from the sets' names and fingerprints (h0, h1, w0, w1), by
    SimHash; the index of prefixes adds what is further apart, and each candidate is checked."""
    first = [F.first(c).alias(c) for c in ("n", "w0", "w1", *COLUMNS[3:], "prefix", "long")]
    points, _ = stored(prints(docs, words).groupBy("h0", "h1").agg(F.min("doc_id").alias("least"), *first), "jaccard-points")
    edges = candidates(points, chunk)
    if near:
        edges = near(points.select("h0", "h1", "w0", "w1")).union(edges)
    edges = similar(docs, points, edges, words, load)
    roots, _ = connected_components(edges.select(_point("a0", "a1").alias("a"), _point("b0", "b1").alias("b")))
    labelled = points.select(_point("h0", "h1").alias("node"), "least").join(roots, "node", "left")
    return labelled.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("doc_id")).select("doc_id").distinct()
