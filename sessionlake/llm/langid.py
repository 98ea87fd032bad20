"""Operator 1: language identification by language-bitmask n-gram filters.

For each learned language the n-grams that its documents use often go into one shared Bloom filter whose slots hold a
bit for each language (bit-sliced: byte ``b`` of a slot has languages ``8 b`` to ``8 b + 7``). The AND of an n-gram's
slots gives all languages that contain it, in one look-up for all of them. A document's score in a language is the
share of its n-grams found there, corrected for the filter's false positives: ``(share - f) / (1 - f)``, with ``f`` the
filled share of the language's bits to the power of the number of slots read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, send

UNKNOWN = "und"


@dataclass(frozen=True)
class Rule:
    """``orders``: lengths of n-grams in characters; ``slots``: of the filter; ``hashes``: slots read for an n-gram;
    ``kept``: n-grams of each order and language; ``sample``: most documents of a language that are learned from,
    chosen by a hash of their id."""

    orders: tuple[int, ...] = (2, 3, 4)
    slots: int = 1 << 18
    hashes: int = 2
    kept: int = 1500
    sample: int = 4000


@dataclass(frozen=True)
class Model:
    languages: list[str]
    filters: np.ndarray  # (bytes a slot, slots)
    false: np.ndarray  # false-positive rate of each language
    typical: np.ndarray  # mean corrected share of a language's own documents
    rule: Rule


_SPACE = 32


def codes(text: str) -> np.ndarray:
    """Code points of the text in lower case, with one space for each stretch of anything but letters, and at the
    ends. Empty where there is no letter."""
    low = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters(low)
    if not letter.any():
        return np.zeros(0, dtype=np.uint32)
    out = np.concatenate((np.array([_SPACE], dtype=np.uint32), np.where(letter, low, np.uint32(_SPACE)), np.array([_SPACE], dtype=np.uint32)))
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != _SPACE) | (out[:-1] != _SPACE)
    return out[keep]


_LETTER_TABLE: list[np.ndarray] = []


def _letters(points: np.ndarray) -> np.ndarray:
    if not _LETTER_TABLE:
        _LETTER_TABLE.append(np.array([chr(i).isalpha() for i in range(0x30000)]))
    return _LETTER_TABLE[0][np.minimum(points, 0x2FFFF)] & (points < 0x30000) | (points >= 0x30000) & (points < 0x323B0)


def grams(points: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of each n-gram."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, order * 0x9E3779B9, dtype=np.uint64)
    for k in range(order):
        h = (h ^ points[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return h


def _slots(h: np.ndarray, rule: Rule) -> list[np.ndarray]:
    size = np.uint64(rule.slots - 1)
    return [((h >> np.uint64(20 * k)) & size).astype(np.int64) for k in range(rule.hashes)]


def fit(labelled: DataFrame, rule: Rule = Rule()) -> Model:
    """Learn from ``labelled`` (doc_id, text, lang). Rows whose lang or text is null teach nothing.

    At most about ``rule.sample`` documents of each language are read, chosen by a hash of their id. Tasks send the
    document counts of all n-grams, known by 64-bit hashes; the most frequent are chosen from the sums, so the model is
    the same whatever the partitions.
    """
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    bytes_each = max(1, (len(languages) + 7) // 8)
    if not languages:
        return Model([], np.zeros((1, rule.slots), dtype=np.uint8), np.zeros(0), np.zeros(0), rule)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, rule.sample / sizes[k])))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(draw < share[F.col("lang")])
    number = {k: i for i, k in enumerate(languages)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames, 2_000_000):
            for lang, texts in frame.groupby("lang")["text"]:
                points = [codes(t) for t in texts]
                for k, order in enumerate(rule.orders):
                    h, n = np.unique(np.concatenate([np.unique(grams(p, order)) for p in points]), return_counts=True)
                    if len(h):
                        yield pd.DataFrame({"lang": number[lang], "k": k, "h": h.view(np.int64), "n": n})

    # Of a bounded sample; summed up before anything is left out.
    counts = sample.mapInPandas(run, "lang int, k int, h long, n long").groupBy("lang", "k", "h").agg(F.sum("n").alias("n"))
    from pyspark.sql.window import Window

    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang", "k").orderBy(F.desc("n"), "h"))).where(F.col("r") <= rule.kept)
    filters = np.zeros((bytes_each, rule.slots), dtype=np.uint8)
    for r in best.select("lang", "h").toLocalIterator():
        h = np.array([r["h"]], dtype=np.int64).view(np.uint64)
        for at in _slots(h, rule):
            filters[r["lang"] // 8, at] |= np.uint8(1 << (r["lang"] % 8))
    filled = np.array([((filters[i // 8] >> (i % 8)) & 1).mean() for i in range(len(languages))])
    model = Model(languages, filters, filled**rule.hashes, np.ones(len(languages)), rule)
    # What share of its n-grams a language's own documents have in the filter: scores become comparable.
    sent = send(spark, model)

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames):
            found = [shares(text, sent.value) for text in frame["text"]]
            rows = [(k, float(s[number[k]])) for k, s in zip(frame["lang"], found) if s is not None]
            if rows:
                yield pd.DataFrame(rows, columns=["lang", "s"]).groupby("lang", as_index=False).agg(s=("s", "sum"), n=("s", "size"))

    for r in sample.mapInPandas(own, "lang string, s double, n long").groupBy("lang").agg((F.sum("s") / F.sum("n")).alias("m")).collect():
        model.typical[number[r["lang"]]] = max(r["m"], 0.05)
    return model


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shares(text: str | None, model: Model) -> np.ndarray | None:
    """For each language the corrected share of the text's n-grams; None without a letter."""
    points = codes(text or "")
    if not len(points) or not model.languages:
        return None
    hits, total = np.zeros(8 * len(model.filters), dtype=np.int64), 0
    for order in model.rule.orders:
        h = grams(points, order)
        if not len(h):
            continue
        at = _slots(h, model.rule)
        total += len(h)
        for b, plane in enumerate(model.filters):
            mask = plane[at[0]]
            for x in at[1:]:
                mask &= plane[x]
            hits[8 * b : 8 * b + 8] += np.bincount(mask, minlength=256) @ _BITS
    share = hits[: len(model.languages)] / max(1, total)
    return (share - model.false) / (1 - model.false)


def judge(text: str | None, model: Model) -> tuple[str, float]:
    """The language and a score from 0 to 1: how far its share stands out from the others'."""
    s = shares(text, model)
    if s is None:
        return UNKNOWN, 0.0
    s = np.maximum(s / model.typical, 0)
    best = int(np.argmax(s))
    odds = np.exp(np.clip((s - s[best]) * 8, -50, 0))
    return model.languages[best], float(odds[best] / odds.sum())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score: a row for each row of ``docs``, from its text alone. Null texts and those without a
    letter are ``und`` with score 0; ties go to the language that sorts first; without a learned language all are
    ``und``."""
    sent = send(docs.sparkSession, model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames):
            found = [judge(t, sent.value) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")
