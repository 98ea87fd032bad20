"""Operator 4: masked pseudo-likelihood by a bidirectional window network trained in numpy.

Every word is predicted from the words on both sides of it, itself masked. Words are hashed into buckets; the buckets'
counts over the whole corpus decide which get a token of their own, the rest share tokens. A token is predicted in two
steps, its class and then the token within the class, so that the probabilities sum to one over all tokens at the cost
of two short vectors. Training is local descent: each task trains a copy on the documents it reads, every position
in one of the rounds at least, and the copies are averaged chunk by chunk, in two levels, weighted by positions; a few rounds of this follow
each other. Document scores are the summed log-probabilities of all tokens. Texts are read and cut into words once: all
later passes read the words' buckets from a scratch table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, send, stored, text_rows


@dataclass(frozen=True)
class Rule:
    """``buckets``: hash buckets of words; ``own``: tokens for the most frequent of them; ``shared``: tokens that the
    rest share; ``classes``; ``side``: words seen on each side; ``dim``: width of the network; ``rounds``: of training;
    ``stride``: one position in so many is trained on, another one each round, all of them in the end; ``batch``, ``rate``: of a step."""

    buckets: int = 1 << 16
    own: int = 1792
    shared: int = 256
    classes: int = 32
    side: int = 2
    dim: int = 32
    rounds: int = 2
    stride: int = 2
    batch: int = 2048
    rate: float = 0.15
    chunks: int = 32
    seed: int = 11

    def __post_init__(self) -> None:
        if self.stride > self.rounds:
            raise ValueError("the rounds must cover every position: stride must not exceed rounds")

    @property
    def tokens(self) -> int:
        return self.own + self.shared

    @property
    def stored(self) -> str:
        return "<u2" if self.buckets <= 1 << 16 else "<u4"

    @property
    def inside(self) -> int:
        return -(-self.tokens // self.classes)


def _bucket(word: str, rule: Rule) -> int:
    return zlib.crc32(word.encode()) % rule.buckets


class Words(dict):
    """The bucket of each word of a text, lower-cased, between white space; looked up once a process."""

    def __init__(self, rule: Rule) -> None:
        self.rule = rule

    def __missing__(self, word: str) -> int:
        b = _bucket(word, self.rule)
        if len(self) < 400_000:
            self[word] = b
        return b

    def of(self, text: str | None) -> np.ndarray:
        found = (text or "").lower().split()
        return np.fromiter(map(self.__getitem__, found), dtype=self.rule.stored, count=len(found))


_WORDS: dict[Rule, Words] = {}


def _words(rule: Rule) -> Words:
    if rule not in _WORDS:
        _WORDS[rule] = Words(rule)
    return _WORDS[rule]


def bucketed(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, words: the bucket of each word of the text, in order, as unsigned integers of two or four bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames):
            found = [_words(rule).of(t).tobytes() for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "words": found})

    return text_rows(docs).mapInPandas(run, "doc_id long, words binary")


def bucket_counts(words: DataFrame, rule: Rule) -> DataFrame:
    """bucket, n: words of the whole corpus (see :func:`bucketed`) in each bucket; tasks send their sums."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(rule.buckets, dtype=np.int64)
        for frame in pieces(frames, column="words"):
            total += np.bincount(np.frombuffer(b"".join(frame["words"]), dtype=rule.stored), minlength=rule.buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    return words.select("words").mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, rule: Rule) -> np.ndarray:
    """The token of each bucket: the most frequent have one of their own, numbered by frequency."""
    token = rule.own + np.arange(rule.buckets) % rule.shared
    best = counts.orderBy(F.desc("n"), "bucket").limit(rule.own).collect()  # bounded by the rule
    token[np.array([r["bucket"] for r in best], dtype=np.int64)] = np.arange(len(best))
    return token.astype(np.int32)


def new_weights(rule: Rule) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(rule.seed)
    v, d = rule.tokens + 1, rule.dim  # the last row stands for places outside the document
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {
        "emb": small(v, d),
        "mix": small(2 * rule.side, d, d) + 0.3 * np.eye(d, dtype=np.float32),
        "bias": np.zeros(d, np.float32),
        "w1": small(d, rule.classes),
        "b1": np.zeros(rule.classes, np.float32),
        "w2": small(rule.classes, d, rule.inside),
        "b2": np.where(np.arange(rule.classes)[:, None] + rule.classes * np.arange(rule.inside)[None, :] < rule.tokens, 0, -1e9).astype(np.float32),
    }


# Token t is in class t % classes, at place t // classes: classes hold equal shares of frequent and rare tokens.
def _contexts(ids: np.ndarray, ends: np.ndarray, rule: Rule) -> np.ndarray:
    """The tokens around each position of documents laid end to end (``ends``: past each one's last), masked at their
    bounds."""
    n, pad = len(ids), rule.tokens
    document = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    out = np.full((2 * rule.side, n), pad, dtype=np.int32)
    offsets = [o for o in range(-rule.side, rule.side + 1) if o]
    for k, o in enumerate(offsets):
        if abs(o) >= n:
            continue
        to, source = (slice(-o, n), slice(0, n + o)) if o < 0 else (slice(0, n - o), slice(o, n))
        same = document[to] == document[source]
        out[k, to] = np.where(same, ids[source], pad)
    return out


# Scores stand in columns, one a position: sums and maxima over rows run along contiguous memory.
def _softmax(z: np.ndarray) -> np.ndarray:
    """The softmax of each column, in place."""
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z /= z.sum(axis=0)
    return z


def _log_prob(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax of each column, at one place a column; ``z`` is used up."""
    z -= z.max(axis=0)
    chosen = z[at, np.arange(z.shape[1])]
    return chosen - np.log(np.exp(z, out=z).sum(axis=0))


def _inner(h: np.ndarray, w: dict[str, np.ndarray], bounds: np.ndarray, rule: Rule) -> np.ndarray:
    """The scores within their class of positions in order of their class."""
    z = np.empty((rule.inside, len(h)), dtype=h.dtype)
    cuts = bounds.tolist()
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            np.matmul(w["w2"][k].T, h[a:b].T, out=z[:, a:b])
            z[:, a:b] += w["b2"][k][:, None]
    return z


def _by_class(c: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The rows in order of their class, and where each class begins. Short integers sort in linear time."""
    order = np.argsort(c.astype(np.uint16), kind="stable")
    return order, np.searchsorted(c[order], np.arange(rule.classes + 1))


class Net:
    def __init__(self, weights: dict[str, np.ndarray], rule: Rule) -> None:
        self.w, self.rule = weights, rule
        self.tables = np.einsum("vd,kde->kve", weights["emb"], weights["mix"])

    def hidden(self, contexts: np.ndarray) -> np.ndarray:
        h = self.tables[0][contexts[0]] + self.w["bias"]
        for k in range(1, len(contexts)):
            h += self.tables[k][contexts[k]]
        return np.tanh(h)

    def log_probs(self, ids: np.ndarray, contexts: np.ndarray, block: int = 8192) -> np.ndarray:
        """The log-probability of each position's token given the tokens around it."""
        out = np.zeros(len(ids))
        for i in range(0, len(ids), block):
            t, h = ids[i : i + block], self.hidden(contexts[:, i : i + block])
            c, place = t % self.rule.classes, t // self.rule.classes
            first = _log_prob(self.w["w1"].T @ h.T + self.w["b1"][:, None], c)
            order, bounds = _by_class(c, self.rule)
            second = np.empty(len(t), dtype=first.dtype)
            second[order] = _log_prob(_inner(h[order], self.w, bounds, self.rule), place[order])
            out[i : i + block] = first.astype(np.float64) + second
        return out


def step(w: dict[str, np.ndarray], sums: dict[str, np.ndarray], ids: np.ndarray, contexts: np.ndarray, rule: Rule) -> None:
    """One step of Adagrad on the mean negative log-probability of a batch, in place."""
    n = len(ids)
    c, place = ids % rule.classes, ids // rule.classes
    rows = contexts.T.reshape(-1)
    e, mix = w["emb"][rows].reshape(n, -1), w["mix"].reshape(-1, rule.dim)  # all places of a position side by side
    h = np.tanh(e @ mix + w["bias"])
    d1 = _softmax(w["w1"].T @ h.T + w["b1"][:, None])
    d1[c, np.arange(n)] -= 1
    g = {"w1": h.T @ d1.T, "b1": d1.sum(axis=1), "w2": np.zeros_like(w["w2"]), "b2": np.zeros_like(w["b2"])}
    order, bounds = _by_class(c, rule)
    own = h[order]
    d2 = _softmax(_inner(own, w, bounds, rule))
    d2[place[order], np.arange(n)] -= 1
    inner = np.empty_like(h)
    cuts = bounds.tolist()
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            np.matmul(own[a:b].T, d2[:, a:b].T, out=g["w2"][k])
            g["b2"][k] = d2[:, a:b].sum(axis=1)
            np.matmul(d2[:, a:b].T, w["w2"][k].T, out=inner[a:b])
    back = d1.T @ w["w1"].T
    back[order] += inner
    back *= 1 - h * h
    g["bias"] = back.sum(axis=0)
    g["mix"] = (e.T @ back).reshape(w["mix"].shape)
    whole = (back @ mix.T).reshape(-1, rule.dim)
    order = np.argsort(rows.astype(np.uint16) if rule.tokens < 1 << 16 else rows, kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    used = rows[starts]
    emb = np.add.reduceat(whole[order], starts, axis=0)
    for name, grad in g.items():
        grad /= n
        sums[name] += grad * grad
        w[name] -= rule.rate * grad / (np.sqrt(sums[name]) + 1e-3)
    emb /= n
    sums["emb"][used] = total = sums["emb"][used] + emb * emb
    w["emb"][used] -= rule.rate * emb / (np.sqrt(total) + 1e-3)


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].reshape(-1) for k in sorted(w)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k], at = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32), at + like[k].size
    return out


def _batches(frames: Iterator[pd.DataFrame], token: np.ndarray, rule: Rule) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Documents in pieces of bounded size: the rows, their tokens end to end, and where each document ends."""
    for frame in pieces(frames, 1_200_000, "words"):
        own = [np.frombuffer(x, dtype=rule.stored) for x in frame["words"]]
        yield frame, token[np.concatenate(own)], np.cumsum([len(x) for x in own])


def picked(n: int, at: int, rule: Rule) -> np.ndarray:
    """The positions of a piece that a round trains on; all rounds together take every one."""
    return np.arange(at % rule.stride, n, rule.stride)


def train(words: DataFrame, token: np.ndarray, rule: Rule) -> dict[str, np.ndarray]:
    """The weights after all rounds over the documents of :func:`bucketed`."""
    spark = words.sparkSession
    w = new_weights(rule)
    for at in range(rule.rounds):
        sent = send(spark, (w, token, at))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            start, token, at = sent.value
            own = {k: v.copy() for k, v in start.items()}
            sums = {k: np.zeros_like(v) for k, v in own.items()}
            seen, held_ids, held_contexts = 0, [], []

            def learn(last: bool) -> int:
                ids, contexts = np.concatenate(held_ids), np.concatenate(held_contexts, axis=1)
                whole = len(ids) if last else len(ids) // rule.batch * rule.batch
                for i in range(0, whole, rule.batch):
                    step(own, sums, ids[i : i + rule.batch], contexts[:, i : i + rule.batch], rule)
                held_ids[:], held_contexts[:] = [ids[whole:]], [contexts[:, whole:]]
                return whole

            for _, ids, ends in _batches(frames, token, rule):
                if len(ids):
                    contexts = _contexts(ids, ends, rule)
                    pick = picked(len(ids), at, rule)
                    held_ids.append(ids[pick])
                    held_contexts.append(contexts[:, pick])
                    seen += learn(False)
            if held_ids:
                seen += learn(True)
            if seen:
                part = TaskContext.get().partitionId()
                chunks = np.array_split(_flat(own).astype(np.float32), rule.chunks)
                yield pd.DataFrame({"part": part, "chunk": range(rule.chunks), "seen": seen, "values": [c.tobytes() for c in chunks]})

        def mean(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("part")
            total = frame["seen"].sum()
            values = sum(np.frombuffer(v, dtype=np.float32).astype(np.float64) * (n / total) for v, n in zip(frame["values"], frame["seen"]))
            return pd.DataFrame([{"part": frame["part"].min(), "chunk": frame["chunk"].iloc[0], "seen": total, "values": values.astype(np.float32).tobytes()}])

        schema = "part int, chunk int, seen long, values binary"
        copies = words.mapInPandas(run, schema)
        some = copies.groupBy("chunk", F.pmod("part", F.lit(64)).alias("p")).applyInPandas(mean, schema)
        averaged = some.groupBy("chunk").applyInPandas(mean, schema).orderBy("chunk").collect()  # the weights alone
        if not averaged:
            return w
        w = _shaped(np.concatenate([np.frombuffer(r["values"], dtype=np.float32) for r in averaged]), w)
    return w


def scored(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_tokens, log_prob (sum over all tokens), mean_log_prob (null without tokens): a row for each row of
    ``docs``.

    Vocabulary and network come from all of ``docs``. Null and empty texts have no token and a sum of zero. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    words, _ = stored(bucketed(docs, rule), "lm-words")
    counts, _ = stored(bucket_counts(words, rule), "lm-counts")
    token = vocabulary(counts, rule)
    w = train(words, token, rule)
    sent = send(spark, (w, token))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Net(sent.value[0], rule)
        for frame, ids, ends in _batches(frames, sent.value[1], rule):
            p = net.log_probs(ids, _contexts(ids, ends, rule)) if len(ids) else np.zeros(0)
            n = np.diff(ends, prepend=0)
            sums = np.zeros(len(n))  # of each document by itself: equal texts get equal sums
            if len(ids):
                sums[n > 0] = np.add.reduceat(p, (ends - n)[n > 0])
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "n_tokens": n, "log_prob": sums, "mean_log_prob": pd.Series(np.where(n > 0, sums / np.maximum(n, 1), np.nan)).astype(object).where(n > 0, None)})

    return words.mapInPandas(run, "doc_id long, n_tokens long, log_prob double, mean_log_prob double")
