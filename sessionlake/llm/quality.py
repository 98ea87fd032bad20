"""Operator 12: a quality classifier: histogram gradient-boosted trees over document statistics.

Every document becomes some thirty statistics of its characters, words and lines, counted over the whole text. Trees are
grown level by level on a bounded sample of labelled rows: statistics are cut into bins once, each level needs only sums
of gradients for each (node, statistic, bin), and all nodes of a level are split at once. A model is four arrays, so that
a batch of documents goes down all trees together: one step of indexing for each level.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, plain, send, text_rows, trimmed

#: Classes of bytes, each a statistic: its share of all bytes.
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"'\"`", b"()[]{}<>", b"|", b"#$%&*+=@^_~\\/", b"-", bytes(range(128, 256)))
_CLASS_OF = np.zeros(256, dtype=np.intp) + len(_CLASSES)
for _n, _members in enumerate(_CLASSES):
    _CLASS_OF[list(_members)] = _n
_LETTERS = re.compile(r"[^\W\d_]")
_TIDY = re.compile(r"[^\W\d_]+[.,;:!?]?")
NAMES = (
    *(f"class_{k}" for k in range(len(_CLASSES) + 1)), "log_bytes", "entropy", "log_words", "word_length", "long_words", "short_words", "distinct_words", "top_word", "doubled_words",
    "no_letter_words", "tidy_words", "upper_words", "title_words", "repeated_triples", "log_lines", "line_words", "repeated_lines", "upper_run", "mark_run",
)


def _run(flags: np.ndarray) -> int:
    """The longest run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def statistics(text: str) -> np.ndarray:
    """The statistics of a whole text; shares of an empty one are zero."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.bincount(raw, minlength=256)
    shares = np.bincount(_CLASS_OF, weights=counts, minlength=len(_CLASSES) + 1) / max(len(raw), 1)
    p = counts[counts > 0] / max(len(raw), 1)
    words = text.split()
    n = max(len(words), 1)
    kinds = Counter(words)
    # What a word is like depends on the word alone: each is looked at once.
    spell = {w: (len(w), not _LETTERS.search(w), bool(_TIDY.fullmatch(w)), w.isupper() and len(w) > 1, w.istitle()) for w in kinds}
    weight = np.array(list(kinds.values()), dtype=float)
    about = np.array(list(spell.values()), dtype=float).reshape(-1, 5)
    number = {w: i for i, w in enumerate(kinds)}
    ids = np.fromiter((number[w] for w in words), dtype=np.int64, count=len(words))
    triples = ids[:-2] * 1_000_003 ** 2 + ids[1:-1] * 1_000_003 + ids[2:] if len(ids) > 2 else ids[:0]
    lines = [x for x in (line.strip() for line in text.split("\n")) if x]
    total = lambda column: float(about[:, column] @ weight) / n if len(about) else 0.0
    length = about[:, 0] if len(about) else np.zeros(0)
    marked = about[ids, 2] == 0 if len(ids) else np.zeros(0, dtype=bool)
    upper = about[ids, 3] == 1 if len(ids) else np.zeros(0, dtype=bool)
    return np.array([
        *shares, np.log1p(len(raw)), float(-(p * np.log2(p)).sum()), np.log1p(len(words)), total(0), float(weight[length > 12].sum()) / n, float(weight[length < 3].sum()) / n, len(kinds) / n,
        float(weight.max(initial=0)) / n, float((ids[1:] == ids[:-1]).sum()) / n, total(1), total(2), total(3), total(4), 1 - len(np.unique(triples)) / max(len(triples), 1) if len(triples) else 0.0,
        np.log1p(len(lines)), len(words) / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0, np.log1p(_run(upper)), np.log1p(_run(marked)),
    ], dtype=np.float32)


@dataclass(frozen=True)
class Rule:
    """Growing trees. ``most``: labelled rows that are learnt from at most, chosen by a hash of doc_id."""

    most: int = 20_000
    trees: int = 60
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    ridge: float = 2.0
    least: float = 8.0  # labelled rows on each side of a split


@dataclass(frozen=True)
class Model:
    """Complete trees in arrays (tree, node): node i has children 2 i + 1 and 2 i + 2. A node that was not split sends
    all rows left (limit: infinity)."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray  # (tree, leaf)

    def margins(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        rows, each = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        at = np.zeros((len(x), trees), dtype=np.intp)
        while inner and at.size and at[0, 0] < inner:  # all rows are on one level
            at = 2 * at + 1 + (x[rows, self.feature[each, at]] > self.limit[each, at])
        return self.base + self.value[each, at - inner].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each column the limits between bins: distinct quantiles."""
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for column in x.T]


def grow(x: np.ndarray, y: np.ndarray, rule: Rule = Rule()) -> Model:
    """Trees of the logistic loss over rows ``x`` with labels ``y`` in 0..1. A split's gain is the usual one of second
    order; at a tie the first statistic and the lowest limit win, so that the order of the rows plays no part."""
    n, width = x.shape
    inner, leaves = (1 << rule.depth) - 1, 1 << rule.depth
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if n else 0.5
    base = float(np.log(rate / (1 - rate)))
    feature, limit = np.zeros((rule.trees, inner), dtype=np.int64), np.full((rule.trees, inner), np.inf, dtype=np.float32)
    value = np.zeros((rule.trees, leaves), dtype=np.float64)
    if not n:
        return Model(base, feature, limit, value)
    cuts = edges(x, rule.bins)
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)])
    margin = np.full(n, base)
    for t in range(rule.trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(rule.depth):
            first, wide = (1 << level) - 1, 1 << level
            best, chosen, at = np.full(wide, 1e-6), np.zeros(wide, dtype=np.int64), np.full(wide, -1)
            for f in range(width):
                size = len(cuts[f]) + 1
                if size == 1:
                    continue
                cell = (node - first) * size + binned[f]
                sums = [np.bincount(cell, weights=w, minlength=wide * size).reshape(wide, size).cumsum(axis=1) for w in (gradient, curve, None)]
                g, h, c = (s[:, :-1] for s in sums)
                ga, ha, ca = (s[:, -1:] for s in sums)
                gain = g * g / (h + rule.ridge) + (ga - g) ** 2 / (ha - h + rule.ridge) - ga * ga / (ha + rule.ridge)
                gain = np.round(np.where((c >= rule.least) & (ca - c >= rule.least), gain, 0), 9)
                top = gain.argmax(axis=1)
                better = gain[np.arange(wide), top] > best
                best[better], chosen[better], at[better] = gain[np.arange(wide), top][better], f, top[better]
            for k in np.flatnonzero(at >= 0):
                feature[t, first + k], limit[t, first + k] = chosen[k], cuts[chosen[k]][at[k]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > limit[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, weights=gradient, minlength=leaves), np.bincount(leaf, weights=curve, minlength=leaves)
        value[t] = -rule.rate * g / (h + rule.ridge)
        margin = margin + value[t][leaf]
    return Model(base, feature, limit, value)


_STATISTICS = "statistics array<float>"


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text (null: empty)."""

    @trimmed
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames):
            yield pd.DataFrame({"doc_id": frame["doc_id"], "statistics": [statistics(t or "") for t in frame["text"]]})

    return text_rows(docs).mapInPandas(run, f"doc_id long, {_STATISTICS}")


def fit(docs: DataFrame, labels: DataFrame, rule: Rule = Rule()) -> Model:
    """Trees for ``labels`` (doc_id, quality 0 or 1) over the texts of ``docs``. Labels of a doc_id are averaged, nulls
    left out; of rows that repeat a doc_id the largest text counts. At most ``rule.most`` doc_ids are learnt from, a
    fixed number whatever the tables' size; without any, every score is a half."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rule.most)
    texts = text_rows(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))
    rows = described(texts).join(chosen, "doc_id").orderBy("doc_id").select("statistics", "label").toArrow()
    x = np.array(rows.column(0).combine_chunks().flatten(), dtype=np.float32).reshape(-1, len(NAMES))
    return grow(x, np.array(rows.column(1), dtype=np.float64), rule)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score, 0 to 1: how likely the label is 1. Null and empty texts have the score of no words."""
    spark, name = docs.sparkSession, "_text"
    sent = send(spark, model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            parts = [np.array([statistics(t or "") for t in part[name]], dtype=np.float32) for part in pieces(iter([pd.DataFrame({name: series})]), column=name)]
            yield pd.Series(np.concatenate([sent.value.scores(x) for x in parts]) if parts else np.zeros(0))

    return docs.select(*plain(docs), score(F.col("text").cast("string")).alias("score"))
