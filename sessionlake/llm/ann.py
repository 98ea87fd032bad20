"""Operator 9: approximate nearest neighbours by learned partitions.

A bounded sample of vectors gets its exact neighbour graph. Balanced label propagation cuts the graph into parts of
equal size with few edges across. A small network (one hidden layer, numpy) learns, from a vector, the share of each
part among its neighbours. It assigns every vector of the table to a part, and sends each query to its most probable
parts, where inner products in double precision rank the candidates. Parts are dealt in blocks of bounded size, so a
part that grew is several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import send, shuffle_partitions, stored


@dataclass(frozen=True)
class Rule:
    """``sample``: most vectors the index is fitted on; ``parts``; ``probes``: parts a query visits; ``near``: neighbours
    in the sample's graph; ``hidden``, ``epochs``: the network; ``block``: most vectors in a task's block."""

    sample: int = 8000
    parts: int = 64
    probes: int = 46
    near: int = 10
    hidden: int = 128
    epochs: int = 25
    block: int = 4096
    seed: int = 7


@dataclass(frozen=True)
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(unit(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def neighbour_graph(x: np.ndarray, near: int) -> np.ndarray:
    """The ``near`` other rows of largest inner product of each row, in blocks."""
    near = min(near, len(x) - 1)
    out = np.zeros((len(x), near), dtype=np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 1024] = np.argpartition(-s, near - 1, axis=1)[:, :near]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, seed: int, rounds: int = 30) -> np.ndarray:
    """A part for each row, sizes at most one apart, few graph edges across.

    Starts from balanced nearest centres; then rows move to the part that most of their neighbours (both directions)
    are in, by gain, as far as the rows that leave that part make room.
    """
    rng = np.random.default_rng(seed)
    n = len(x)
    quota = np.full(parts, n // parts)
    quota[: n % parts] += 1
    centres = x[rng.choice(n, parts, replace=False)]
    label = np.zeros(n, dtype=np.int64)
    for _ in range(8):
        label = _fill(x @ centres.T, quota)
        centres = unit(np.stack([x[label == p].mean(axis=0) if (label == p).any() else centres[p] for p in range(parts)]))
    a = np.repeat(np.arange(n), graph.shape[1])
    b = graph.reshape(-1)
    best, least = label, np.inf
    for _ in range(rounds):
        votes = np.zeros((n, parts), dtype=np.float32)
        np.add.at(votes, (a, label[b]), 1)
        np.add.at(votes, (b, label[a]), 1)
        cut = int((label[a] != label[b]).sum())
        if cut >= least:
            break
        best, least = label, cut
        label = _fill(votes + 0.5 * np.eye(parts, dtype=np.float32)[label], quota)
    return best


def _fill(value: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """Each row to its best part with room; rows with most to lose choose first."""
    order = np.argsort(-value, axis=1)
    ranked = np.take_along_axis(value, order, axis=1)
    room, label = quota.copy(), np.full(len(value), -1)
    for i in np.argsort(-(ranked[:, 0] - ranked[:, min(1, value.shape[1] - 1)]), kind="stable"):
        for p in order[i]:
            if room[p]:
                label[i], room[p] = p, room[p] - 1
                break
    return label


def train(x: np.ndarray, rule: Rule) -> Router:
    """The router of a sample (rows of vectors). One part suffices for fewer rows than parts."""
    rng = np.random.default_rng(rule.seed)
    parts = min(rule.parts, max(1, len(x)))
    flat = unit(x)
    dim = x.shape[1]
    if parts < rule.parts or len(x) < 2:
        return Router(np.zeros((dim, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32))
    graph = neighbour_graph(flat, rule.near)
    label = balanced_partition(flat, graph, parts, rule.seed)
    soft = np.zeros((len(x), parts), dtype=np.float32)
    np.add.at(soft, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].reshape(-1)), 1)
    soft[np.arange(len(x)), label] += graph.shape[1] / 4
    soft /= soft.sum(axis=1, keepdims=True)
    shape = [(dim, rule.hidden), (rule.hidden,), (rule.hidden, parts), (parts,)]
    w = [rng.normal(0, np.sqrt(2 / s[0]), s).astype(np.float32) if len(s) == 2 else np.zeros(s, np.float32) for s in shape]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(rule.epochs):
        rate = 3e-3 * 0.5 * (1 + np.cos(np.pi * epoch / rule.epochs))
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            at = order[i : i + 256]
            hidden = np.maximum(flat[at] @ w[0] + w[1], 0)
            z = hidden @ w[2] + w[3]
            z -= z.max(axis=1, keepdims=True)
            e = np.exp(z)
            d = (e / e.sum(axis=1, keepdims=True) - soft[at]) / len(at)
            back = (d @ w[2].T) * (hidden > 0)
            grads = [flat[at].T @ back, back.sum(axis=0), hidden.T @ d, d.sum(axis=0)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Router(*w)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (doubles): rows whose vector is there, not zero, and wholly finite. Rows without id take no part."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda c: c != 0))


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in order of the components: equal vectors get equal scores anywhere."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * c[:, k]
    return out


def best(q: np.ndarray, q_id: np.ndarray, c: np.ndarray, c_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest of the candidates to each query, never itself: query, candidate and score, ties to smaller ids."""
    s = q @ c.T
    s[q_id[:, None] == c_id[None, :]] = -np.inf
    if s.shape[1] > k:
        edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        scale = np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max()
        a, b = np.nonzero((s >= (edge - 1e-12 * scale)[:, None]) & (s > -np.inf))
    else:
        a, b = np.nonzero(s > -np.inf)
    score = exact_scores(q[a], c[b])
    order = np.lexsort((c_id[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    keep = rank < k
    return q_id[a[keep]], c_id[b[keep]], score[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, rule: Rule = Rule(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found for each row of ``queries``.

    The router is fitted on at most ``rule.sample`` vectors, chosen by a hash of their id; every vector is indexed.
    Vectors that are null, zero, or hold a null or non-finite component take no part on either side, nor do those of
    another length than the most common one. Copies are ranked by id; rows that repeat an id count once, with the vector
    that sorts first.
    """
    spark = vectors.sparkSession
    n = shuffle_partitions(spark)
    sizes = usable(vectors, id_col, vector_col).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = usable(vectors, id_col, vector_col).where(F.size("v") == sizes["d"])
    asked = usable(queries, id_col, vector_col).where(F.size("v") == sizes["d"]).groupBy("id").agg(F.min("v").alias("v"))
    draw = F.pmod(F.xxhash64("id", F.lit("ann")), F.lit(1 << 20)) / float(1 << 20)
    # Twice the sample's expected size at most: the bound on what the driver gets.
    drawn = rows.where(draw < min(1.0, rule.sample / sizes["count"])).orderBy("id").limit(2 * rule.sample)
    x = np.array([r["v"] for r in drawn.select("v").collect()], dtype=np.float64).reshape(-1, sizes["d"])
    router = train(x, rule)
    sent = send(spark, router)

    def assign(probes: int, copies: int):  # noqa: ANN202
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if not len(frame):
                    continue
                x = np.stack(frame["v"].to_numpy())
                z = sent.value.logits(x)
                many = min(probes, z.shape[1])
                part = np.argsort(-z, axis=1, kind="stable")[:, :many].astype(np.int32)
                at = np.repeat(np.arange(len(frame)), many)
                yield pd.DataFrame({"part": part.reshape(-1), "id": frame["id"].to_numpy()[at], "v": frame["v"].to_numpy()[at]})

        return run

    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    indexed, _ = stored(rows.mapInPandas(assign(1, 1), "part int, id long, v array<double>"), "ann-index")
    routed, _ = stored(asked.mapInPandas(assign(rule.probes, 1), "part int, id long, v array<double>"), "ann-queries")
    # Blocks of candidates and of queries by a hash of the id; every pair of blocks of a part is one group.
    number = lambda name: F.ceil(F.col("count") / rule.block).cast("int").alias(name)
    blocks = indexed.groupBy("part").count().select("part", number("cs")).join(routed.groupBy("part").count().select("part", number("qs")), "part")
    block = lambda many: F.pmod(F.xxhash64("id"), F.col(many)).cast("int")
    c = indexed.join(F.broadcast(blocks), "part").select("part", block("cs").alias("cb"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"), "id", "v")
    q = routed.join(F.broadcast(blocks), "part").select("part", block("qs").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("cs") - 1)).alias("cb"), "id", "v")

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        cs, cid = np.stack(left["v"].to_numpy()), left["id"].to_numpy()
        qs, qid = np.stack(right["v"].to_numpy()), right["id"].to_numpy()
        found = [best(qs[i : i + 512], qid[i : i + 512], cs, cid, k) for i in range(0, len(qs), 512)]
        a, b, s = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    keys = ["part", "cb", "qb"]
    found = c.repartition(n, *keys).groupBy(*keys).cogroup(q.repartition(n, *keys).groupBy(*keys)).applyInPandas(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
