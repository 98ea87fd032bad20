import hashlib
import re

import pytest

from sessionlake.llm import positional


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts, items, n=10):
    out = {}
    for doc, text in texts.items():
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for i in range(max(1, len(v) - n + 1) if v else 0):
                win = v[i : i + n]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        found.add(str(item))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def got(frame):
    return {r["doc_id"]: tuple(r)[1:] for r in positional.digests(frame).collect()}


@pytest.mark.parametrize("segment_words,block_words", [(1 << 20, 1_000_000), (3000, 400)])
def test_against_brute_force(spark, documents, sf_dir, texts, segment_words, block_words):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = positional.contamination(documents, items, 10, segment_words, block_words)
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    expected = brute(texts, rows)
    assert got(found) == expected
    assert any(x[4] for x in expected.values())


def test_short_items_ties_and_borders(spark):
    docs = {1: "a b c a b c", 2: "c a", 3: "b", 4: "x A-B y", 5: None, 6: ""}
    items = [(10, "a b"), (2, "A, b!"), (3, "c a b c"), (4, "..."), (5, None), (None, "b")]
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = got(positional.contamination(frame, spark.createDataFrame(items, "item_id long, text string"), 10))
    assert found == brute(docs, [x for x in items if x[0] is not None])
    assert found[2][1] == 0  # no phrase runs from one document into the next


def test_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs")], "item_id long, text string")
    found = positional.digests(positional.contamination(awkward, items)).collect()
    assert len(found) == awkward.count()
    assert sorted(r["doc_id"] for r in found if r["contaminated"]) == [1, 2, 2]
    assert positional.contamination(nothing, items).count() == 0
    assert all(not r["contaminated"] for r in positional.digests(positional.contamination(awkward, items.where("false"))).collect())
    kept = positional.decontaminated(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 3


def test_proximity_against_brute_force(spark):
    docs = {1: "a x b y a b", 2: "b q q q a", 3: "a", 4: "b a"}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {(r["doc_id"], r["position"]) for r in positional.proximity(frame, ["a b"], 3, segment_words=6).collect()}
    split = {d: words(t) for d, t in docs.items()}
    expected = {(d, p) for d, w in split.items() for p in range(len(w)) if w[p] in "ab" and {"a", "b"} <= set(w[p : p + 3])}
    assert found == expected
