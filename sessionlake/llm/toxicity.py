"""Operator 7: toxicity from the nearest labelled examples, by exact TF-IDF cosine on block-max inverted indexes.

Terms are all words that at least ``least`` examples hold. A term's weight is (1 + log tf) idf times its relevance: how
many times likelier than others a toxic example is to hold it, by the lower confidence bound of the odds ratio, from 1
for most words up to ``exp(cap)``. (With plain idf, neighbours are alike in subject and not in tone.) For each term the
index has a list of (example, weight) in order of examples, cut at blocks of examples, with the largest weight of each
block. A query adds up these maxima into an upper bound for every block, opens blocks from the highest bound down, and
stops where no block can still hold one of the ``k`` nearest: exact, most blocks unopened where a text has telling
words. Votes of the nearest, weighted by distance, are calibrated out of fold: the examples of each fold are scored with
the terms, weights and index of the others alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, pieces, send, stored, trimmed

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Rule:
    """``sample``: most labelled rows of each label that are learned from and indexed, chosen by a hash of their id;
    ``least``: examples a term needs; ``cap``: logarithm of the largest relevance; ``k``: neighbours; ``block``:
    examples in a block; ``folds``: of the calibration; ``doubt``: weight of the base rate among the votes."""

    sample: int = 1500
    least: int = 2
    cap: float = 4.0
    k: int = 25
    block: int = 128
    folds: int = 3
    doubt: float = 0.5


def counted(text: str | None) -> dict[str, int]:
    """How often each word stands in a text: letters alone, in lower case."""
    out: dict[str, int] = {}
    for piece, n in Counter((text or "").lower().split()).items():
        for w in (piece,) if piece.isalpha() else _WORD.findall(piece):
            out[w] = out.get(w, 0) + n
    return out


def relevance(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float, cap: float) -> np.ndarray:
    """From the numbers of toxic and clean examples that hold each term: the odds ratio's lower bound (95 %), at least
    1 and at most exp(cap)."""
    a, b, c, d = toxic + 0.5, all_toxic - toxic + 0.5, clean + 0.5, all_clean - clean + 0.5
    low = np.log(a * d / (b * c)) - 1.96 * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return np.exp(np.clip(low, 0, cap))


def unit(tf: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = (1 + np.log(tf)) * weight
    return out / max(float(np.linalg.norm(out)), 1e-300)


class BlockMax:
    """The inverted index. ``vectors``: (term numbers, ascending, and weights) of each example."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int) -> None:
        self.n, self.block, self.blocks = len(vectors), block, -(-max(1, len(vectors)) // block)
        example = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, dtype=np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        order = np.lexsort((example, term))
        self.example, self.weight = example[order].astype(np.int32), weight[order]
        cell = term[order].astype(np.int64) * self.blocks + self.example // block
        self.starts = np.searchsorted(cell, np.arange(n_terms * self.blocks + 1)).astype(np.int32)
        most = np.zeros(n_terms * self.blocks)
        np.maximum.at(most, cell, self.weight)
        # Half the memory; rounded up, they are bounds still.
        self.most = np.where(most > 0, np.nextafter(most.astype(np.float32), np.float32(2)), np.float32(0)).astype(np.float32).reshape(n_terms, self.blocks)

    def _scores(self, at: np.ndarray, weight: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The cosine with each example of the blocks; 0 for the others."""
        if 4 * len(blocks) < self.blocks:
            cells = (at[:, None] * self.blocks + blocks[None, :]).reshape(-1)
            first = self.starts[cells]
            n = self.starts[cells + 1] - first
            index = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            return np.bincount(self.example[index], self.weight[index] * np.repeat(np.repeat(weight, len(blocks)), n), minlength=self.n)
        # Many blocks: whole lists, which lie in one piece each, cost less than picking.
        first, end = self.starts[at * self.blocks], self.starts[(at + 1) * self.blocks]
        lists = list(zip(first.tolist(), end.tolist()))
        example = np.concatenate([self.example[a:b] for a, b in lists])
        value = np.concatenate([self.weight[a:b] for a, b in lists]) * np.repeat(weight, end - first)
        score = np.bincount(example, value, minlength=self.n)
        inside = np.zeros(self.blocks, dtype=bool)
        inside[blocks] = True
        return np.where(np.repeat(inside, self.block)[: self.n], score, 0)

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The ``k`` examples of largest cosine above zero (ties to the first), their cosines, blocks opened."""
        bound = weight @ self.most[at].astype(np.float64)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        found, cosine, opened = np.zeros(0, dtype=np.int64), np.zeros(0), 0
        # The best two blocks set the mark that the bounds of the others must reach; then all those at once.
        for now in (order[:2], order[2:]):
            if len(cosine) >= k:
                now = now[bound[now] >= cosine[k - 1] - 1e-9]
            if not len(now):
                continue
            opened += len(now)
            score = self._scores(at, weight, now)
            least = max(np.partition(score, -k)[-k] if len(score) > k else 0.0, cosine[k - 1] if len(cosine) >= k else 0.0)
            new = np.flatnonzero((score > 0) & (score >= least - 1e-9))
            found, cosine = np.concatenate((found, new)), np.concatenate((cosine, score[new]))
            best = np.lexsort((found, -np.round(cosine, 12)))[:k]
            found, cosine = found[best], cosine[best]
        return found, cosine, opened


@dataclass
class Model:
    number: dict[str, int]
    weight: np.ndarray  # of each term: idf times relevance
    index: BlockMax
    ids: np.ndarray
    labels: np.ndarray
    base: float  # rate of the label among the examples
    bare: float  # score of texts without any term
    steps: tuple[np.ndarray, np.ndarray]  # calibration: votes and rates, both ascending
    rule: Rule

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers, ascending, and weights of unit length."""
        get, tf = self.number.get, {}
        for piece, n in Counter((text or "").lower().split()).items():  # as counted() does
            if (i := get(piece)) is not None:
                tf[i] = tf.get(i, 0) + n
            elif not piece.isalpha():
                for w in _WORD.findall(piece):
                    if (i := get(w)) is not None:
                        tf[i] = tf.get(i, 0) + n
        if not tf:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        at, n = np.array(list(tf), dtype=np.int64), np.array(list(tf.values()), dtype=np.int64)
        order = np.argsort(at)
        return at[order], unit(n[order], self.weight[at[order]])

    def vote(self, at: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """The share of the label among the nearest, weighted by distance, and which they are."""
        found, cosine, _ = self.index.nearest(at, weight, self.rule.k)
        # Distance 1 - cosine: the weight falls from 1 / 0.05 for a copy to 0 for no common term.
        w = 1 / (0.05 + 1 - np.minimum(cosine, 1.0)) - 1 / 1.05
        return float((w @ self.labels[found] + self.rule.doubt * self.base) / (w.sum() + self.rule.doubt)), found

    def score(self, text: str | None) -> tuple[float, list[int]]:
        """The calibrated score, and the ids of the nearest examples, nearest first, as evidence."""
        at, weight = self.vector(text)
        if not len(at):
            return self.bare, []
        vote, found = self.vote(at, weight)
        return float(np.interp(vote, *self.steps)), self.ids[found].tolist()


def _rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic fit of y on x by pooling adjacent violators: the pools' mean x and y."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, n in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist()):
        pools.append([a, b, n])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1] - 1e-15:
            p, q = pools[-2], pools.pop()
            n = p[2] + q[2]
            p[:] = [(p[0] * p[2] + q[0] * q[2]) / n, (p[1] * p[2] + q[1] * q[2]) / n, n]
    return np.array([p[0] for p in pools]), np.array([min(0.999, max(0.001, (p[1] * p[2] + 0.5 * 0.1) / (p[2] + 0.1))) for p in pools])


@dataclass
class Examples:
    """The bounded sample, as term numbers and counts, and what holds each term: (terms, folds, 2 labels)."""

    ids: np.ndarray
    labels: np.ndarray
    folds: np.ndarray
    terms: list[tuple[np.ndarray, np.ndarray]]
    held: np.ndarray

    def model(self, number: dict[str, int], use: np.ndarray, folds: list[int], rule: Rule) -> Model:
        """Terms, weights and index of the examples ``use``, which are those of ``folds``."""
        held = self.held[:, folds].sum(axis=1)
        labels = self.labels[use]
        n, toxic = len(use), float(labels.sum())
        df = held.sum(axis=1)
        weight = np.where(df > 0, np.log1p(n / np.maximum(df, 1)), 0) * relevance(held[:, 1], held[:, 0], toxic, n - toxic, rule.cap)
        vectors = [(t, unit(tf, weight[t])) for t, tf in (self.terms[i] for i in use)]
        # Examples with the same leading terms side by side: their blocks are then the only ones a query opens.
        lead = [(t[np.argsort(-w, kind="stable")][:4].tolist(), int(self.ids[i])) for i, (t, w) in zip(use, vectors)]
        order = sorted(range(n), key=lead.__getitem__)
        base = (toxic + 1) / (n + 2)
        return Model(number, weight, BlockMax([vectors[i] for i in order], len(weight), rule.block), self.ids[use][order], labels[order], base, base, (np.array([0.0, 1.0]), np.array([0.0, 1.0])), rule)


def _draw(of: Column) -> Column:
    return F.pmod(F.xxhash64(of, F.lit("toxicity")), F.lit(1 << 20)) / float(1 << 20)


def _share(rows: DataFrame, rule: Rule) -> tuple[Column, dict[int, int]]:
    """Of rows with ``toxic`` 0 or 1: the share of each label to draw, and how many there are."""
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    share = lambda k: F.lit(min(1.0, rule.sample / max(1, sizes.get(k, 0))))
    return F.when(F.col("toxic") == 1, share(1)).otherwise(share(0)), sizes


def fit(labelled: DataFrame, rule: Rule = Rule(), sizes: dict[int, int] | None = None) -> Model:
    """Learn from ``labelled`` (doc_id, text, toxic 0 or 1). Rows with a null label teach nothing; null texts are empty.

    About ``rule.sample`` rows of each label are read, which bounds what the driver gathers and broadcasts; equal texts
    of one label are one example. ``sizes``: how many rows of each label there are, if ``labelled`` was drawn from them.
    Scores are rates among all labelled rows. Without labelled rows every text gets 1/2 less one millionth.
    """
    spark = labelled.sparkSession
    rows = labelled.where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    if sizes is None:
        share, sizes = _share(rows, rule)
        rows = rows.where(_draw(F.col("doc_id")) < share)
    drawn = rows.withColumn("fold", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(rule.folds)).cast("int"))
    sample, _ = stored(drawn.groupBy("fold", "toxic", F.coalesce("text", F.lit("")).alias("text")).agg(F.min("doc_id").alias("doc_id")), "toxicity-sample")

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for frame in pieces(frames):
            for text, fold, toxic in zip(frame["text"], frame["fold"], frame["toxic"]):
                total.update((w, fold, toxic) for w in counted(text))
        if total:
            yield pd.DataFrame([(*key, n) for key, n in total.items()], columns=["word", "fold", "toxic", "n"])

    holders = sample.mapInPandas(trimmed(words), "word string, fold int, toxic int, n long").groupBy("word")
    columns = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == k), F.col("n")).otherwise(0)).alias(f"n{f}_{k}") for f in range(rule.folds) for k in (0, 1)]
    often = holders.agg(F.sum("n").alias("n"), *columns).where(F.col("n") >= rule.least).drop("n").toPandas().sort_values("word")  # of the bounded sample
    number = {w: i for i, w in enumerate(often["word"])}
    held = often.drop(columns="word").to_numpy(dtype=np.float64).reshape(len(often), rule.folds, 2)
    sent = send(spark, number)

    def known(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames):
            found = [sorted((sent.value[w], n) for w, n in counted(t).items() if w in sent.value) for t in frame["text"]]
            yield frame[["doc_id", "toxic", "fold"]].assign(terms=[np.array(f, dtype=np.int32).tobytes() for f in found])

    got = sample.mapInPandas(trimmed(known), "doc_id long, toxic int, fold int, terms binary").toPandas().sort_values(["doc_id", "toxic", "terms"], na_position="first")
    terms = [np.frombuffer(t, dtype=np.int32).reshape(-1, 2).astype(np.int64) for t in got["terms"]]
    some = np.array([len(t) > 0 for t in terms], dtype=bool)
    labels, folds = got["toxic"].to_numpy(dtype=np.float64), got["fold"].to_numpy()
    at = np.flatnonzero(some)
    every = Examples(got["doc_id"].fillna(-1).to_numpy(dtype=np.int64)[at], labels[at], folds[at], [(terms[i][:, 0], terms[i][:, 1]) for i in at], held)
    model = every.model(number, np.arange(len(at)), list(range(rule.folds)), rule)
    # One sampled row stands for so many labelled ones.
    stands = np.array([sizes.get(k, 0) / max(1, int((labels == k).sum())) for k in (0, 1)])
    rate = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2) if sum(sizes.values()) else 0.499999
    alone = stands[labels[~some].astype(int)]
    model.bare = float((alone @ labels[~some] + rate) / (alone.sum() + 1)) if len(alone) else rate
    if len(at) >= 20:
        votes = np.zeros(len(at))
        for f in range(rule.folds):
            rest = every.model(number, np.flatnonzero(every.folds != f), [x for x in range(rule.folds) if x != f], rule)
            for i in np.flatnonzero(every.folds == f):
                t, tf = every.terms[i]
                votes[i] = rest.vote(t, unit(tf, rest.weight[t]))[0]
        model.steps = _rising(votes, every.labels, stands[every.labels.astype(int)])
    return model


def learn(docs: DataFrame, labels: DataFrame, rule: Rule = Rule()) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic). The labels are drawn before the join, so the
    side that is broadcast has about twice ``rule.sample`` rows and no text is shuffled. A doc_id that repeats among the
    labels counts once, as toxic if any of its rows is."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share, sizes = _share(known, rule)
    chosen = known.where(_draw(F.col("doc_id")) < share)
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"), rule, sizes)
    give_back()  # the driver's, too, which goes on
    return model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), evidence (ids of the nearest labelled examples): a row for each row of ``docs``, from
    its whole text alone. Null and empty texts have no term and get the rate of the label among such examples."""
    sent = send(docs.sparkSession, model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames):
            found = [sent.value.score(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": [s for s, _ in found], "evidence": [e for _, e in found]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(trimmed(run), "doc_id long, score double, evidence array<long>")


def score_column(docs: DataFrame, model: Model) -> Column:
    """The score as a column over ``docs``, for filters that keep the other columns as they are."""
    sent = send(docs.sparkSession, model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            yield pd.Series([sent.value.score(t)[0] for t in text], dtype="float64")
        give_back()

    return score(F.col("text"))


def without_toxic(docs: DataFrame, labels: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``docs`` without those scored 0.5 or more, learned from the labelled ones among them. A labelled document may
    find itself, as a copy of it would: its label is the best evidence there is. No other column plays a part; rows that
    repeat are judged alike, null and empty texts are judged like labelled texts without a known word, and an empty
    table stays empty."""
    return docs.where(score_column(docs, learn(docs, labels, rule)) < 0.5)
