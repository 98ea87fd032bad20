"""Operator 6: mixing sources to target weights by iterative proportional fitting.

Tokens are counted for each cell (source, language, topic). Raking scales the cells so that their sums meet target
shares for each of the three in turn, until all do. Topics are clusters: k-means on hashed TF-IDF of the words, whose
idf, starts and centres come from all documents. A document is then kept with the probability that its cell's weight
gives, under a cap of one and a token budget, decided by a hash of its id: the same document falls the same way in any
run. Words are counted once, by Spark ML, and stored; passes over packed vectors alone fit the clusters in Arrow batches.
Centres are sums of integers, so that neither the partitions nor the order of tasks changes a cluster. Only the raking of
a bounded table of cells is done on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import give_back, join_groups, plain, send, small_batches, stored

DIMENSIONS = ("source", "lang", "topic")
SCALE = 1 << 30  # one, in the sums of centres

@dataclass(frozen=True)
class Rule:
    """``topics``: clusters of texts; ``passes``, ``still``: their fit ends after so many passes over all documents, or
    when no centre moves further than this; ``features``: hash buckets of words; ``smoothing``: target shares are natural token shares to this power, scaled to one (1: as they are, 0: equal);
    ``keep``: share of all tokens to keep; ``cells``: most cells that are raked on the driver; ``rounds``, ``close``:
    raking ends after so many rounds, or with all sums this close; ``seed``: of the draw."""

    topics: int = 8
    passes: int = 10
    still: float = 1e-4
    features: int = 4096
    smoothing: dict[str, float] | None = None
    keep: float = 0.9
    cells: int = 200_000
    rounds: int = 100
    close: float = 1e-9
    seed: int = 42

    def power(self, dimension: str) -> float:
        return (self.smoothing or {"source": 0.9, "lang": 0.9, "topic": 1.0})[dimension]


def words(text: Column) -> Column:
    """What stands between stretches of white space, in lower case, with empty strings at blank ends."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")


def tokens(found: Column) -> Column:
    """How many of :func:`words` there are, and one for the end of the document."""
    blank = (F.element_at(found, 1) == "").cast("int") + (F.element_at(found, -1) == "").cast("int")
    return F.when((F.size(found) == 1) & (F.element_at(found, 1) == ""), 1).otherwise(F.size(found) - blank + 1).cast("long")


def _ragged(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The items of an Arrow array of lists, and how many each list holds."""
    at = lists.offsets.to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(at)


def _packed(values: np.ndarray, many: np.ndarray) -> pa.Array:
    """Each row's values as bytes."""
    ends = np.concatenate(([0], np.cumsum(many) * values.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(rows: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    ends = np.frombuffer(rows.buffers()[1], dtype=np.int32, count=len(rows) + 1, offset=4 * rows.offset)
    size = np.dtype(kind).itemsize
    data = rows.buffers()[2]
    values = np.frombuffer(data, dtype=kind, count=int(ends[-1] - ends[0]) // size, offset=int(ends[0])) if data and ends[-1] > ends[0] else np.zeros(0, dtype=kind)
    return values, np.diff(ends) // size


def _sums(values: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The sum of each row's values; 0 for rows without any. A row's sum does not depend on the rows around it."""
    out, some = np.zeros(len(many)), many > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(many) - many)[some])
    return out


@dataclass
class Topics:
    """``idf`` of each bucket of words; ``centres``: a row a cluster."""

    idf: np.ndarray
    centres: np.ndarray

    @property
    def kind(self) -> type:
        """Of packed buckets."""
        return np.uint16 if len(self.idf) <= 1 << 16 else np.int32

    def units(self, words: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows: buckets, weights of unit length in whole parts of ``SCALE``, and how many each row has."""
        (at, many), (tf, _) = _ragged(words), _ragged(counts)
        weight = tf * self.idf[at]
        length = np.sqrt(_sums(weight * weight, many))
        return at, np.rint(weight * np.repeat(SCALE / np.where(length > 0, length, 1.0), many)), many

    def apart(self, at: np.ndarray, weight: np.ndarray, many: np.ndarray) -> np.ndarray:
        """The squared distance of each row (by column) to each centre, less the row's own square; rounded, so that equal
        ones are ties."""
        return np.stack([np.round(float(c @ c) - 2 / SCALE * _sums(weight * c[at], many), 7) for c in self.centres])


def _units(found: DataFrame, topics: Topics) -> DataFrame:
    """start, at, weight: the rows of ``found`` as packed vectors, stored, since each pass reads them."""
    sent = send(found.sparkSession, topics)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, weight, many = sent.value.units(b.column(0), b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(2), _packed(at.astype(sent.value.kind), many), _packed(weight.astype(np.int32), many)], ["start", "at", "weight"])
        give_back()

    return stored(found.select("counts.indices", "counts.values", "start").mapInArrow(run, "start double, at binary, weight binary"), "mixing-units")[0]


def _vectors(b: pa.RecordBatch, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, many = _unpacked(b.column("at"), kind)
    return at.astype(np.int64), _unpacked(b.column("weight"), np.int32)[0].astype(np.float64), many


def _start(found: DataFrame, topics: Topics) -> np.ndarray | None:
    """One more centre by k-means++: a row of all, with a chance in proportion to its squared distance to the nearest
    centre (alike for all without centres): the one whose exponential clock, set by a hash of the id, rings first."""
    sent = send(found.sparkSession, topics)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            at, weight, many = _vectors(b, sent.value.kind)
            far = _sums(weight * weight, many) / SCALE**2 + sent.value.apart(at, weight, many).min(axis=0) if len(sent.value.centres) else np.ones(len(many))
            clock = -np.log1p(-b.column("start").to_numpy(zero_copy_only=False))
            time = np.where(far > 1e-6, clock / np.maximum(far, 1e-6), np.inf)  # what is left of a centre's copies is rounding
            least = time.min(initial=np.inf)
            for i in np.flatnonzero(time == least) if np.isfinite(least) else []:
                end = int(many[: i + 1].sum())
                now = (float(time[i]), at[end - many[i] : end].tolist(), weight[end - many[i] : end].tolist())
                best = now if best is None else min(best, now)
        if best:
            yield pa.RecordBatch.from_pydict({"time": [best[0]], "at": pa.array([best[1]], pa.list_(pa.int32())), "weight": pa.array([best[2]], pa.list_(pa.float64()))})
        give_back()

    rows = found.mapInArrow(first, "time double, at array<int>, weight array<double>")
    one = rows.orderBy("time", "at", "weight").first()
    if one is None:
        return None
    centre = np.zeros(len(topics.idf))
    centre[one["at"]] = np.array(one["weight"]) / SCALE
    return centre


def _moved(found: DataFrame, topics: Topics) -> np.ndarray:
    """The centres' next places: means of the rows nearest to each; a centre without rows stays."""
    sent, k, n = send(found.sparkSession, topics), len(topics.centres), len(topics.idf)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whole numbers below 2 ** 53 in a batch, so exact in any order; the last column counts rows.
        sums = np.zeros((k, n + 1), dtype=np.int64)
        for b in batches:
            at, weight, many = _vectors(b, sent.value.kind)
            near = sent.value.apart(at, weight, many).argmin(axis=0)
            cell = np.repeat(near * n, many) + at
            sums[:, :n] += np.bincount(cell, weight, minlength=k * n).astype(np.int64).reshape(k, n)
            sums[:, n] += np.bincount(near, minlength=k)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(some, pa.int32()), "sum": pa.array(sums.reshape(-1)[some], pa.int64())})
        give_back()

    rows = found.select("at", "weight").mapInArrow(total, "cell int, sum long").groupBy("cell").agg(F.sum("sum").alias("sum"))
    sums = np.zeros(k * (n + 1), dtype=np.int64)
    for r in rows.collect():  # clusters times buckets at most
        sums[r["cell"]] = r["sum"]
    sums = sums.reshape(k, n + 1)
    return np.where(sums[:, n:] > 0, sums[:, :n] / SCALE / np.maximum(sums[:, n:], 1), topics.centres)


def fit_topics(vectors: DataFrame, found: DataFrame, rule: Rule) -> Topics | None:
    """The idf of words and the clusters, of all rows of ``found`` (counts, tokens, start) that have words; None without
    such rows. ``vectors``: the same rows with counts as Spark ML's vectors."""
    some = found.where(F.col("tokens") > 1)
    if some.isEmpty():
        return None
    idf = IDF(inputCol="counts", outputCol="weighted").fit(vectors.where(F.col("tokens") > 1)).idf.toArray()
    topics = Topics(idf, np.zeros((0, rule.features)))
    some = _units(some, topics)
    while len(topics.centres) < rule.topics and (centre := _start(some, topics)) is not None:
        topics = Topics(idf, np.vstack((topics.centres, centre)))
    for _ in range(rule.passes):
        was, topics = topics, Topics(idf, _moved(some, topics))
        if np.sqrt(((topics.centres - was.centres) ** 2).sum(axis=1)).max() < rule.still:
            break
    return topics


def cluster_column(found: DataFrame, topics: Topics) -> Column:
    """The nearest centre as a column over ``found``; of equally near ones the first."""
    sent = send(found.sparkSession, topics)

    @F.arrow_udf("int")
    def nearest(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for words, counts in batches:
            yield pa.array(sent.value.apart(*sent.value.units(words, counts)).argmin(axis=0), pa.int32())
        give_back()

    return nearest(F.col("counts.indices"), F.col("counts.values"))


def counted(docs: DataFrame, rule: Rule, *others: Column) -> DataFrame:
    """cell (source, lang, topic), tokens, draw, and the columns ``others`` of documents. The texts are read once."""
    spark = docs.sparkSession
    small_batches(spark)
    named = [F.coalesce(F.col(c).cast("string"), F.lit(_NULL)).alias(c) for c in ("source", "lang")]
    id_, text = F.col("doc_id").cast("string"), F.col("text").cast("string")
    draws = [draw(id_, text, rule.seed).alias("draw"), draw(id_, text, rule.seed + 1).alias("start")]
    rows = docs.select(*[c.alias(f"other{k}") for k, c in enumerate(others)], *named, *draws, words(text).alias("words"))
    hashed = HashingTF(numFeatures=rule.features, inputCol="words", outputCol="counts").transform(rows)
    vectors, path = stored(hashed.withColumn("tokens", tokens(F.col("words"))).drop("words"), "mixing-rows")
    # The vectors as plain columns, which Arrow takes.
    flat = StructType([StructField(f.name, VectorUDT.sqlType() if f.name == "counts" else f.dataType) for f in vectors.schema])
    found = spark.read.schema(flat).parquet(path)
    topics = fit_topics(vectors, found, rule)
    cluster = cluster_column(found, topics) if topics else F.lit(0)
    topic = F.when(F.col("tokens") == 1, "empty").otherwise(F.concat(F.lit("t"), F.col("cluster")))
    return found.withColumn("cluster", cluster).select(*[f"other{k}" for k in range(len(others))], F.struct("source", "lang", topic.alias("topic")).alias("cell"), "tokens", "draw")


def rake(counts: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray], rounds: int, close: float) -> np.ndarray:
    """``counts`` scaled until the sums over ``places`` (cell to value, for each dimension) meet ``targets``."""
    w = counts.astype(np.float64)
    for _ in range(rounds):
        gap = 0.0
        for place, target in zip(places, targets):
            sums = np.bincount(place, w, minlength=len(target))
            gap = max(gap, float(np.abs(sums - target).max(initial=0) / max(target.sum(), 1e-300)))
            w *= np.where(sums > 0, target / np.maximum(sums, 1e-300), 0)[place]
        if gap < close:
            break
    return w


def probabilities(wanted: np.ndarray, counts: np.ndarray, keep: float) -> np.ndarray:
    """Keeping probabilities in proportion to wanted / counts, at most one, that keep the share of all tokens; what the
    cap takes from some cells the others make up for."""
    ratio = wanted / np.maximum(counts, 1e-300)
    goal, low, high = keep * counts.sum(), 0.0, 1.0 / max(ratio[ratio > 0].min(initial=1.0), 1e-300)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * ratio) * counts).sum() < goal else (low, mid)
    return np.minimum(1, high * ratio)


_NULL = "\x00null"


def cell_table(rows: DataFrame) -> DataFrame:
    """The tokens and documents of each cell, of rows with cell and tokens."""
    return rows.groupBy("cell").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).select("cell.*", "tokens", "docs")


def weights(cells: DataFrame, rule: Rule = Rule(), targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``cells`` with columns wanted (raked tokens) and p (keeping probability). ``targets``: shares by dimension and
    value in place of the smoothed natural ones; values without a target keep nothing.

    Up to ``rule.cells`` cells are raked in numpy on the driver. Beyond that each step of a round is an aggregation and
    a join over the stored table of cells, with the same result.
    """
    spark = cells.sparkSession
    cells, _ = stored(cells, "mixing-cells")
    if cells.count() > rule.cells:
        return _weights_joined(cells, rule, targets)
    rows = sorted((tuple(r[d] for d in DIMENSIONS), r["tokens"], r["docs"]) for r in cells.collect())
    counts = np.array([n for _, n, _ in rows], dtype=np.float64)
    places, goals = [], []
    for k, d in enumerate(DIMENSIONS):
        values = sorted({key[k] for key, _, _ in rows})
        number = {v: i for i, v in enumerate(values)}
        place = np.array([number[key[k]] for key, _, _ in rows], dtype=np.int64)
        natural = np.bincount(place, counts, minlength=len(values))
        share = np.array([targets[d].get(v, 0.0) for v in values]) if targets and d in targets else natural ** rule.power(d)
        places.append(place)
        goals.append(share / max(share.sum(), 1e-300) * counts.sum())
    wanted = rake(counts, places, goals, rule.rounds, rule.close)
    p = probabilities(wanted, counts, rule.keep) if len(rows) else wanted
    data = [(*key, int(n), int(m), float(w), float(x)) for (key, n, m), w, x in zip(rows, wanted, p)]
    return spark.createDataFrame(data, "source string, lang string, topic string, tokens long, docs long, wanted double, p double")


def _weights_joined(cells: DataFrame, rule: Rule, targets: dict[str, dict[str, float]] | None) -> DataFrame:
    total = cells.agg(F.sum("tokens")).first()[0]
    now = cells.withColumn("wanted", F.col("tokens").cast("double"))
    goals = {}
    for d in DIMENSIONS:
        if targets and d in targets:
            given = cells.sparkSession.createDataFrame(list(targets[d].items()), "value string, share double")
            share = given.join(cells.select(F.col(d).alias("value")).distinct(), "value", "left_semi")
        else:
            share = cells.groupBy(F.col(d).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(rule.power(d))).alias("share"))
        whole = share.agg(F.sum("share")).first()[0] or 1.0
        goals[d], _ = stored(share.select(F.col("value").alias(d), (F.col("share") / whole * total).alias("goal")), "mixing-goal")
    for _ in range(rule.rounds):
        gap = 0.0
        for d in DIMENSIONS:
            sums, _ = stored(now.groupBy(d).agg(F.sum("wanted").alias("sum")).join(goals[d], d, "left").fillna(0.0, ["goal"]), "mixing-sums")
            gap = max(gap, sums.agg(F.max(F.abs(F.col("sum") - F.col("goal")))).first()[0] / total)
            scale = F.when(F.col("sum") > 0, F.col("goal") / F.col("sum")).otherwise(0.0)
            now = now.join(sums.select(d, scale.alias("_scale")), d).withColumn("wanted", F.col("wanted") * F.col("_scale")).drop("_scale")
        now, _ = stored(now, "mixing-now")
        if gap < rule.close:
            break
    ratio = F.col("wanted") / F.col("tokens")
    low, high = 0.0, 1.0 / (now.where("wanted > 0").agg(F.min(ratio)).first()[0] or 1.0)
    for _ in range(60):
        mid = (low + high) / 2
        kept = now.agg(F.sum(F.least(F.lit(1.0), mid * ratio) * F.col("tokens"))).first()[0]
        low, high = (mid, high) if kept < rule.keep * total else (low, mid)
    return now.select(*DIMENSIONS, "tokens", "docs", "wanted", F.least(F.lit(1.0), high * ratio).alias("p"))


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the document's id (its text where it has none)."""
    return F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), text, F.lit("")), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def _judged(rows: DataFrame, rule: Rule, targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """``rows`` of :func:`counted`, with p."""
    cells = weights(cell_table(rows), rule, targets).select(F.struct(*DIMENSIONS).alias("cell"), "docs", "p")
    cells, _ = stored(cells, "mixing-weights")
    if cells.count() <= rule.cells:
        return rows.join(F.broadcast(cells.drop("docs")), "cell")
    return join_groups(rows, cells, "cell", "docs", rows.count())


def mixed(docs: DataFrame, rule: Rule = Rule(), targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, p, weight, kept: a row for each row of ``docs``.

    weight is 1 / p for kept documents, by which sums over them estimate sums over all. Null sources and languages are
    cells of their own; null and empty texts have one token and the topic ``empty``; rows that repeat a doc_id share
    their fate where they share a cell. An empty table gives no rows.
    """
    rows, _ = stored(counted(docs, rule, F.col("doc_id")), "mixing-found")
    null = lambda c: F.when(F.col(f"cell.{c}") != _NULL, F.col(f"cell.{c}")).alias(c)
    kept = F.col("draw") < F.col("p")
    return _judged(rows, rule, targets).select(F.col("other0").alias("doc_id"), null("source"), null("lang"), F.col("cell.topic").alias("topic"), "tokens", F.round("p", 9).alias("p"), F.when(kept, F.round(1 / F.col("p"), 9)).alias("weight"), kept.alias("kept"))


def sampled(docs: DataFrame, rule: Rule = Rule(), targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`mixed` keeps, with their own columns, whatever their names."""
    rows = counted(docs, rule, F.struct(*plain(docs)))
    kept = _judged(rows, rule, targets).where(F.col("draw") < F.col("p"))
    return kept.select([F.col("other0").getField(c).alias(c) for c in docs.columns])
