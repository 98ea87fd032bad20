import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sessionlake.llm import toxicity
from sessionlake.llm.queries import op7_toxicity
from sessionlake.llm.toxicity import BlockMax, Rule


def test_block_max_search_is_exact():
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.linalg.norm(w)))
    index, dense = BlockMax(vectors, 40, 16), np.zeros((700, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    opened = 0
    for i in range(0, 700, 7):
        found, cosine, n = index.nearest(*vectors[i], 10)
        s = dense @ dense[i]
        best = np.lexsort((np.arange(700), -np.round(s, 12)))[:10]
        assert found.tolist() == best[s[best] > 0].tolist()
        assert np.allclose(cosine, s[found])
        opened += n
    assert opened < 100 * index.blocks  # blocks are skipped


def test_whole_vocabulary_cosine_against_brute_force(spark, documents, sf_dir):
    """Weights, cosines and neighbours of documents, over all words that two examples hold, from plain sums."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [(r["doc_id"], r["text"], labels[r["doc_id"]]) for r in documents.collect() if labels.get(r["doc_id"]) is not None]
    seen = {}
    for doc, text, toxic in sorted(rows):
        seen.setdefault((text, toxic), doc)  # equal texts of a label are one example
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    words = {doc: Counter(toxicity._WORD.findall(text.lower())) for (text, _), doc in seen.items()}
    real, n = {doc: toxic for (_, toxic), doc in seen.items()}, len(seen)
    pos = sum(real.values())
    df = {}
    for doc, own in words.items():
        for w in own:
            df.setdefault(w, [0, 0])[real[doc]] += 1
    def weight(w):
        a, b, c, d = df[w][1] + 0.5, pos - df[w][1] + 0.5, df[w][0] + 0.5, n - pos - df[w][0] + 0.5
        low = math.log(a * d / (b * c)) - 1.96 * math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        return math.log(1 + n / sum(df[w])) * math.exp(min(4, max(0, low)))
    kept = {w: weight(w) for w in df if sum(df[w]) >= 2}
    assert set(model.number) == set(kept)
    vectors = {}
    for doc, own in words.items():
        v = {w: (1 + math.log(k)) * kept[w] for w, k in own.items() if w in kept}
        size = math.sqrt(sum(x * x for x in v.values()))
        vectors[doc] = {w: x / size for w, x in v.items()}
    for (text, _), doc in list(seen.items())[:25]:
        at, own = model.vector(text)
        assert {i: round(x, 9) for i, x in zip(at.tolist(), own.tolist())} == {model.number[w]: round(x, 9) for w, x in vectors[doc].items()}
        cosines = {d: sum(x * other.get(w, 0) for w, x in vectors[doc].items()) for d, other in vectors.items()}
        found, cosine, _ = model.index.nearest(at, own, 25)
        assert np.allclose(cosine, sorted((x for x in cosines.values() if x > 0), reverse=True)[:25])
        assert np.allclose(cosine, [cosines[d] for d in model.ids[found].tolist()])


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(0)
    plain = ["river", "stone", "garden", "window", "paper", "music", "train", "bread", "cloud", "letter"]
    bad = ["grubmoron", "sludgehead", "vilescum"]
    rows = []
    for i in range(600):
        w = [rng.choice(plain) + rng.choice(["", "s", "ly"]) for _ in range(rng.randrange(20, 80))]
        toxic = int(i % 9 == 0)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "ish", "ed"]))
        rows.append((i, " ".join(w), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out(made):
    model = toxicity.fit(made.where("doc_id % 5 <> 0"))
    found = {r["doc_id"]: r for r in toxicity.scores(made, model).collect()}
    real = {r["doc_id"]: r["toxic"] for r in made.collect()}
    assert all((found[i]["score"] >= 0.5) == bool(real[i]) for i in real if i % 5 == 0)
    assert all(found[i]["evidence"] for i in real if real[i])
    assert all(real[e] for i in real if real[i] and i % 5 == 0 for e in found[i]["evidence"][:3])


def test_every_text_with_a_known_word_has_neighbours(spark, documents, sf_dir):
    model = toxicity.learn(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for r in toxicity.scores(documents, model).join(documents.select("doc_id", "text"), "doc_id").collect():
        assert bool(r["evidence"]) == any(w in model.number for w in toxicity.counted(r["text"]))


def test_query_learns_from_its_fold_alone(spark, sf_dir):
    rows = op7_toxicity(spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = {r["doc_id"] for r in rows if r["held_out"]}
    assert not held & {e for r in rows for e in r["evidence"]}


def test_stage_keeps_the_rest(made):
    kept = toxicity.without_toxic(made.drop("toxic"), made.select("doc_id", "toxic"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(600) if i % 9}


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (8, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(awkward.select("doc_id", "text").join(labels, "doc_id"))
    found = toxicity.scores(awkward, model).collect()
    assert len(found) == awkward.count() and all(0 <= r["score"] <= 1 for r in found)
    none = toxicity.fit(nothing.select("doc_id", "text").join(labels, "doc_id"))
    assert toxicity.scores(awkward, none).count() == awkward.count()
    assert toxicity.scores(nothing, model).count() == 0
    assert toxicity.without_toxic(awkward, labels.where("false")).count() == awkward.count()


def test_isotonic_fit_rises():
    rng = np.random.default_rng(2)
    x = rng.random(500)
    steps, rates = toxicity._rising(x, (rng.random(500) < x).astype(float), np.ones(500))
    assert (np.diff(steps) > 0).all() and (np.diff(rates) >= 0).all() and Rule().k == 25
