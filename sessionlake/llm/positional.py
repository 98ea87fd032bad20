"""Operator 10: benchmark decontamination by a distributed, stored positional inverted index.

The index is partitioned by document. Each task numbers the words of its documents one after the other, cuts them into
segments of about ``segment_words`` words (a longer document is a segment alone) and stores for every segment its
vocabulary and, for each term, the ascending list of positions. Nothing is shuffled and the index knows no benchmark:
it is written once as a table in the shared folder, and any set of items can be searched in it.

A search takes the test windows in blocks of a bounded number of words. Per window the terms are ordered by their count
in the whole index, rarest first; the offset-adjusted list of the rarest is intersected with those of the others, one
after the other, and what is left are exact occurrences. All windows of a block are intersected at once, as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, send, stored, text_rows, trimmed

#: Word bytes keep their value, A-Z become a-z, all others a space: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_INDEX = "segment string, docs binary, no_id binary, sizes binary, terms binary, counts binary, positions binary"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD).split()


def build_index(docs: DataFrame, segment_words: int = 1 << 20) -> DataFrame:
    """A row for each segment: its documents' ids and word counts, its terms, their counts and positions.

    Positions are int32 within the segment, stored as differences within each term's list. Null texts have no words;
    rows without doc_id keep their place (``no_id``); an empty table gives no segment.
    """

    def pack(ids: list, sizes: list[int], tokens: list[int], vocabulary: dict[bytes, int]) -> pd.DataFrame:
        term = np.array(tokens, dtype=np.int32)
        counts = np.bincount(term, minlength=len(vocabulary)).astype(np.int32)
        order = np.argsort(term, kind="stable").astype(np.int32)
        positions = np.diff(order, prepend=np.int32(0))
        starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
        if len(order):
            positions[starts[counts > 0]] = order[starts[counts > 0]]
        given = [0 if x is None or x != x else int(x) for x in ids]
        row = {
            "docs": np.array(given, dtype=np.int64).tobytes(),
            "no_id": np.array([x is None or x != x for x in ids], dtype=np.uint8).tobytes(),
            "sizes": np.array(sizes, dtype=np.int64).tobytes(),
            "terms": b" ".join(vocabulary),
            "counts": counts.tobytes(),
            "positions": positions.astype(np.int32).tobytes(),
        }
        return pd.DataFrame([{"segment": ""} | row])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        sizes: list[int] = []
        tokens: list[int] = []
        vocabulary: dict[bytes, int] = {}
        for frame in frames:
            for doc, text in zip(frame["doc_id"].astype(object).tolist(), frame["text"].tolist()):
                found = words(text)
                if tokens and len(tokens) + len(found) > segment_words or len(ids) >= segment_words:
                    yield pack(ids, sizes, tokens, vocabulary).assign(segment=f"{part}-{number}")
                    ids, sizes, tokens, vocabulary, number = [], [], [], {}, number + 1
                add = vocabulary.setdefault
                tokens += [add(w, len(vocabulary)) for w in found]
                ids.append(doc)
                sizes.append(len(found))
        if ids:
            yield pack(ids, sizes, tokens, vocabulary).assign(segment=f"{part}-{number}")

    return text_rows(docs).mapInPandas(trimmed(run), _INDEX)


def term_counts(index: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """How often each of the wanted terms stands in the whole index. Tasks send sums; ``wanted`` bounds the result."""
    asked = send(index.sparkSession, wanted)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[bytes, int] = {}
        for frame in frames:
            for terms, counts in zip(frame["terms"], frame["counts"]):
                for w, n in zip(terms.split(), np.frombuffer(counts, dtype=np.int32).tolist()):
                    if w in asked.value:
                        total[w] = total.get(w, 0) + n
        if total:
            yield pd.DataFrame({"term": list(total), "n": list(total.values())})

    found = index.select("terms", "counts").mapInPandas(trimmed(run), "term binary, n long")
    return {bytes(r["term"]): r["n"] for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def item_blocks(items: DataFrame, window: int, block_words: int) -> Iterator[dict[tuple[bytes, ...], list[str]]]:
    """The items' windows with their item ids, in blocks of about ``block_words`` words, one in memory at a time.
    An item of fewer words than the window, but not none, is one window."""
    block: dict[tuple[bytes, ...], list[str]] = {}
    total = 0
    for row in items.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator(prefetchPartitions=False):
        if row["item_id"] is None:
            continue
        found = words(row["text"])
        for i in range(max(1, len(found) - window + 1) if found else 0):
            ids = block.setdefault(tuple(found[i : i + window]), [])
            if not ids or ids[-1] != row["item_id"]:
                ids.append(row["item_id"])
        total += len(found)
        if total >= block_words:
            yield block
            block, total = {}, 0
    yield block


class Segment:
    """A stored segment, opened for searches."""

    def __init__(self, docs: bytes, no_id: bytes, sizes: bytes, terms: bytes, counts: bytes, positions: bytes) -> None:
        self.docs, self.no_id = np.frombuffer(docs, dtype=np.int64), np.frombuffer(no_id, dtype=np.uint8)
        self.sizes = np.frombuffer(sizes, dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.term = {w: i for i, w in enumerate(terms.split())}
        self.counts = np.frombuffer(counts, dtype=np.int32).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        steps = np.frombuffer(positions, dtype=np.int32)
        # Each list begins with its first position; a running sum within lists gives the rest.
        running = np.cumsum(steps, dtype=np.int64)
        before = np.where(self.starts > 0, running[np.maximum(self.starts - 1, 0)], 0) if len(steps) else np.zeros(0, dtype=np.int64)
        self.positions = running - np.repeat(before, self.counts)
        self.length = int(self.ends[-1]) if len(self.ends) else 0
        # Lists one after the other are ascending in (term, position): one binary search tests membership in any list.
        self.keys = np.repeat(np.arange(len(self.counts), dtype=np.int64), self.counts) * (self.length + 1) + self.positions

    def listed(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(term), dtype=bool)
        key = term * (self.length + 1) + position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (position >= 0) & (position < self.length)

    def phrases(self, order: list[tuple[list[bytes], list[int]]], lengths: np.ndarray, chunk: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences (window number, first position) of windows given as their terms, rarest first, and offsets."""
        known = [(k, [self.term[w] for w in terms], offsets) for k, (terms, offsets) in enumerate(order) if all(w in self.term for w in terms)]
        if not known:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        number = np.array([k for k, _, _ in known])
        most = max(len(t) for _, t, _ in known)
        terms = np.array([t + [-1] * (most - len(t)) for _, t, _ in known], dtype=np.int64)
        offsets = np.array([o + [0] * (most - len(o)) for _, _, o in known], dtype=np.int64)
        out_w, out_p = [], []
        sizes = self.counts[terms[:, 0]]
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(chunk, int(sizes.sum()) + chunk, chunk))
        low = 0
        for high in [*np.unique(np.minimum(cuts + 1, len(known))).tolist()]:
            if high <= low:
                continue
            part = np.arange(low, high)
            low = high
            n = sizes[part]
            window = np.repeat(part, n)
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = self.positions[np.repeat(self.starts[terms[part, 0]], n) + within] - offsets[window, 0]
            for k in range(1, most):
                if not len(window):
                    break
                kept = (terms[window, k] < 0) | self.listed(terms[window, k], start + offsets[window, k])
                window, start = window[kept], start[kept]
            # A phrase lies within one document.
            inside = (start >= 0) & (np.searchsorted(self.ends, start, side="right") == np.searchsorted(self.ends, start + lengths[number[window]] - 1, side="right"))
            out_w.append(number[window[inside]])
            out_p.append(start[inside])
        return np.concatenate(out_w), np.concatenate(out_p)

    def close(self, terms: list[bytes], within: int) -> list[tuple[int, int]]:
        """Proximity: (document number, first position) of the stretches of at most ``within`` words that hold all
        the terms, each stretch beginning at one of them and no shorter one beginning there."""
        if not terms or any(w not in self.term for w in terms):
            return []
        lists = []
        for w in dict.fromkeys(terms):
            t = self.term[w]
            lists.append(self.positions[self.starts[t] : self.starts[t] + self.counts[t]])
        lists.sort(key=len)
        starts = np.unique(np.concatenate(lists))
        document = np.searchsorted(self.ends, starts, side="right")
        limit = np.minimum(starts + within, self.ends[document])
        good = np.ones(len(starts), dtype=bool)
        for positions in lists:
            at = np.searchsorted(positions, starts)
            good &= (at < len(positions)) & (positions[np.minimum(at, len(positions) - 1)] < limit)
        return [(int(d), int(p - (self.ends[d] - self.sizes[d]))) for d, p in zip(document[good], starts[good])]


def _opened(frame: pd.DataFrame) -> Iterator[tuple[str, Segment]]:
    for row in frame.itertuples(index=False):
        yield row.segment, Segment(row.docs, row.no_id, row.sizes, row.terms, row.counts, row.positions)


def _block_hits(index: DataFrame, block: dict[tuple[bytes, ...], list[str]]) -> DataFrame:
    """segment, spans (document number, first word, past the last), items (document number, item id) of a block."""
    spark = index.sparkSession
    counts = term_counts(index, {w for window in block for w in window})
    order = []
    for window in block:
        rare = sorted(range(len(window)), key=lambda i: (counts.get(window[i], 0), i))
        order.append(([window[i] for i in rare], rare))
    asked = send(spark, (order, np.array([len(w) for w in block], dtype=np.int64), list(block.values())))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order, lengths, ids = asked.value
        for frame in frames:
            for name, segment in _opened(frame):
                window, start = segment.phrases(order, lengths)
                document = np.searchsorted(segment.ends, start, side="right")
                first = start - (segment.ends - segment.sizes)[document] if len(start) else start
                spans = np.stack((document, first, first + lengths[window]), axis=1) if len(start) else np.zeros((0, 3), dtype=np.int64)
                pairs = np.unique(np.stack((document, window), axis=1), axis=0).tolist() if len(start) else []
                items = sorted({(d, i) for d, w in pairs for i in ids[w]})
                yield pd.DataFrame([{"segment": name, "spans": np.ascontiguousarray(spans).tobytes(), "items": [f"{d}:{i}" for d, i in items]}])

    return index.mapInPandas(trimmed(run), "segment string, spans binary, items array<string>")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, segment_words: int = 1 << 20, block_words: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, spans (array of [from, to) in words, merged), items (ascending ids as strings): a row for each
    row of ``docs``.

    Null and empty texts have no words and no hits; items that are null, have no word or no id are never found; items
    or windows that repeat count under each of their ids. An empty table of items leaves every document clean.
    """
    index, _ = stored(build_index(docs, segment_words), "positional-index")
    hits = None
    for block in item_blocks(items, window, block_words):
        found = _block_hits(index, block)
        hits = found if hits is None else hits.union(found)

    def merged(name: str, segment: Segment, spans: list[np.ndarray], items: list[str]) -> pd.DataFrame:
        n = len(segment.docs)
        own: list[set[str]] = [set() for _ in range(n)]
        for x in items:
            d, _, i = x.partition(":")
            own[int(d)].add(i)
        out: list[list[list[int]]] = [[] for _ in range(n)]
        rows = np.concatenate(spans) if spans else np.zeros((0, 3), dtype=np.int64)
        for d, a, b in rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))].tolist():
            if out[d] and a <= out[d][-1][1]:
                out[d][-1][1] = max(out[d][-1][1], b)
            else:
                out[d].append([a, b])
        ids = pd.array(segment.docs, dtype="Int64")
        ids[segment.no_id.astype(bool)] = pd.NA
        return pd.DataFrame({"doc_id": ids, "n_words": segment.sizes, "spans": out, "items": [sorted(x) for x in own]})

    schema = "doc_id long, n_words long, spans array<array<long>>, items array<string>"
    sizes = index.select("segment", "docs", "no_id", "sizes")

    def light(row) -> Segment:  # noqa: ANN001
        return Segment(row.docs, row.no_id, row.sizes, b"", b"", b"")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                spans = [np.frombuffer(x, dtype=np.int64).reshape(-1, 3) for x in row.spans]
                yield merged(row.segment, light(row), spans, [i for part in row.items for i in part])

    gathered = hits.groupBy("segment").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    return sizes.join(gathered, "segment").mapInPandas(trimmed(run), schema)


def proximity(docs: DataFrame, phrases: list[str], within: int, segment_words: int = 1 << 20) -> DataFrame:
    """phrase, doc_id, position: stretches of at most ``within`` words that hold every word of the phrase, by the
    word they begin with."""
    index, _ = stored(build_index(docs, segment_words), "positional-index")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, segment in _opened(frame):
                rows = [(p, None if segment.no_id[d] else int(segment.docs[d]), at) for p in phrases for d, at in segment.close(words(p), within)]
                if rows:
                    yield pd.DataFrame(rows, columns=["phrase", "doc_id", "position"]).astype({"doc_id": "Int64"})

    return index.mapInPandas(trimmed(run), "phrase string, doc_id long, position long")


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query from those of :func:`contamination`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def _free(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows in whose text a window of a benchmark item stands. A row is judged by its text alone (by
    64 bits of its hash), so rows that repeat a doc_id or have none are rows like any other."""
    key = F.xxhash64(F.col("text").cast("string"))
    bad = contamination(docs.select(key.alias("doc_id"), "text"), items, window).where(F.size("spans") > 0).select(F.col("doc_id").alias(_free("_text_key", docs))).distinct()
    return docs.join(bad, key == bad[bad.columns[0]], "left_anti").select(plain(docs))
