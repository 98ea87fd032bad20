import itertools
import zlib

import numpy as np

from sessionlake.llm import quality
from sessionlake.llm.queries import QUERIES


def test_held_out_rows(spark, sf_dir):
    """Accuracy on rows that were not learnt from, on the next larger tables."""
    sf = sf_dir.replace("sf0.001", "sf0.01")
    found = {r["doc_id"]: r for r in QUERIES["op12_quality"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(found) == docs.count()
    for doc, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(doc).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in found and found[r["doc_id"]]["held_out"]}
    right = [found[d]["predicted"] == q for d, q in labels.items()]
    assert np.mean(right) >= 0.95
    good, bad = ([found[d]["score"] for d, q in labels.items() if q == k] for k in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a, b in itertools.product(good, bad)]) >= 0.95


def test_labels_and_names_play_no_part(spark, documents, sf_dir):
    """Only the text is scored."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(documents, labels, quality.Rule(trees=5))
    plain = {r["doc_id"]: r["score"] for r in quality.scored(documents, model).collect()}
    other = documents.selectExpr("doc_id", "text", "'xx' as lang", "'other' as source", "0L as n_chars")
    assert {r["doc_id"]: r["score"] for r in quality.scored(other, model).collect()} == plain


def brute_margin(model, row):
    total = model.base
    for feature, limit, value in zip(model.feature, model.limit, model.value):
        at = 0
        while at < len(feature):
            at = 2 * at + 1 + int(row[feature[at]] > limit[at])
        total += value[at - len(feature)]
    return total


def test_traversal_against_one_row_at_a_time():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.5)).astype(float)
    model = quality.grow(x, y, quality.Rule(trees=30))
    assert np.allclose(model.margins(x), [brute_margin(model, r) for r in x])
    assert ((model.scores(x) > 0.5) == y).mean() > 0.97
    order = rng.permutation(len(x))
    again = quality.grow(x[order], y[order], quality.Rule(trees=30))
    assert np.allclose(again.margins(x), model.margins(x), atol=1e-6)


def test_first_split_against_all_splits():
    """The first node takes the split with the largest gain of all."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(200, 4)), 1).astype(np.float32)
    y = (x[:, 2] + 0.3 * rng.normal(size=200) > 0.4).astype(float)
    rule = quality.Rule(trees=1, depth=1, bins=1000)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    g, h = p - y, np.full(200, p * (1 - p))

    def gain(f, limit):
        left = x[:, f] <= limit
        if min(left.sum(), (~left).sum()) < rule.least:
            return 0.0
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + rule.ridge)
        return part(left) + part(~left) - g.sum() ** 2 / (h.sum() + rule.ridge)

    best = max((round(gain(f, v), 9), -f, -v) for f in range(4) for v in np.unique(x[:, f])[:-1])
    model = quality.grow(x, y, rule)
    assert (model.feature[0, 0], model.limit[0, 0]) == (-best[1], np.float32(-best[2]))


def test_statistics():
    s = lambda text: dict(zip(quality.NAMES, quality.statistics(text)))
    assert len(quality.NAMES) == len(quality.statistics("")) and not np.any(quality.statistics(""))
    a = s("one two two\none two two\n")
    assert np.isclose(a["doubled_words"], 2 / 6) and np.isclose(a["distinct_words"], 2 / 6) and np.isclose(a["repeated_lines"], 0.5) and np.isclose(a["repeated_triples"], 1 / 4)
    b = s("LOUD!! LOUD!! x | y")
    assert np.isclose(b["upper_words"], 2 / 5) and np.isclose(b["upper_run"], np.log1p(2)) and np.isclose(b["no_letter_words"], 1 / 5)
    assert s("ab")["class_0"] == 1 and s("é")["class_12"] == 1 and np.isfinite(quality.statistics("\ud800 x")).all()


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (5, 0), (8, 1)], "doc_id long, quality int")
    for train in (awkward, nothing):
        model = quality.fit(train, labels, quality.Rule(least=1))
        found = quality.scored(awkward, model)
        rows = found.collect()
        assert len(rows) == awkward.count() and all(0 <= r[-1] <= 1 for r in rows)
        assert found.columns == [*awkward.columns, "score"]
        assert quality.scored(nothing, model).collect() == []
    unknown = quality.fit(awkward, labels.where("false"))
    assert {r[-1] for r in quality.scored(awkward, unknown).collect()} == {0.5}
