import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlake.llm import mixing
from sessionlake.llm.mixing import DIMENSIONS, Rule


def plain_rake(cells, goals, rounds=2000):
    w = {k: float(v) for k, v in cells.items()}
    for _ in range(rounds):
        for d, goal in enumerate(goals):
            sums = {}
            for k, v in w.items():
                sums[k[d]] = sums.get(k[d], 0) + v
            w = {k: v * goal[k[d]] / sums[k[d]] if sums[k[d]] else 0 for k, v in w.items()}
    return w


@pytest.fixture(scope="module")
def cells(documents):
    return mixing.cell_table(mixing.counted(documents, Rule()))


def test_raking_against_brute_force(cells):
    rule = Rule(rounds=2000, close=1e-13)
    found = {tuple(r[d] for d in DIMENSIONS): r for r in mixing.weights(cells, rule).collect()}
    counts = {k: r["tokens"] for k, r in found.items()}
    total, goals = sum(counts.values()), []
    for d, name in enumerate(DIMENSIONS):
        share = {}
        for k, v in counts.items():
            share[k[d]] = share.get(k[d], 0) + v
        share = {k: v ** rule.power(name) for k, v in share.items()}
        goals.append({k: v / sum(share.values()) * total for k, v in share.items()})
    plain = plain_rake(counts, goals)
    assert all(abs(found[k]["wanted"] - v) < 1e-4 * total for k, v in plain.items())
    kept = sum(r["p"] * r["tokens"] for r in found.values())
    assert abs(kept - rule.keep * total) < 1e-6 * total and all(0 <= r["p"] <= 1 for r in found.values())


def test_joined_raking_is_the_same(cells):
    a = {tuple(r[d] for d in DIMENSIONS): (r["wanted"], r["p"]) for r in mixing.weights(cells, Rule(rounds=4, close=0)).collect()}
    b = {tuple(r[d] for d in DIMENSIONS): (r["wanted"], r["p"]) for r in mixing.weights(cells, Rule(rounds=4, close=0, cells=1)).collect()}
    assert set(a) == set(b) and all(np.allclose(a[k], b[k], rtol=1e-6) for k in a)


def test_targets_are_met(documents):
    targets = {"lang": {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}}
    found = mixing.weights(mixing.cell_table(mixing.counted(documents, Rule())), Rule(rounds=500), targets)
    sums = {r["lang"]: r["w"] for r in found.groupBy("lang").agg(F.sum("wanted").alias("w")).collect()}
    total = sum(sums.values())
    assert all(abs(sums[k] / total - v) < 0.02 for k, v in targets["lang"].items())


def test_absent_targets_count_for_nothing_on_either_path(cells):
    targets = {"lang": {"en": 0.4, "fr": 0.3, "xx": 0.3}}
    a = {tuple(r[d] for d in DIMENSIONS): (r["wanted"], r["p"]) for r in mixing.weights(cells, Rule(rounds=4, close=0), targets).collect()}
    b = {tuple(r[d] for d in DIMENSIONS): (r["wanted"], r["p"]) for r in mixing.weights(cells, Rule(rounds=4, close=0, cells=1), targets).collect()}
    assert set(a) == set(b) and all(np.allclose(a[k], b[k], rtol=1e-6, atol=1e-9) for k in a)


def test_topics_follow_the_words(spark):
    themes = [["river", "fish", "water", "boat"], ["engine", "wheel", "motor", "brake"], ["violin", "opera", "piano", "choir"]]
    rows = [(i, " ".join(themes[i % 3][(i * 7 + j * j) % 4] for j in range(30)), "en", "a") for i in range(90)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r["topic"] for r in mixing.mixed(frame, Rule(topics=3)).collect()}
    assert len({(i % 3, t) for i, t in found.items()}) == len(set(found.values())) == 3
    assert found == {r["doc_id"]: r["topic"] for r in mixing.mixed(frame.repartition(7), Rule(topics=3)).collect()}


def test_cells_joined_by_size_are_the_same(documents):
    few, many = ({(r["doc_id"], r["p"], r["kept"]) for r in mixing.mixed(documents, Rule(rounds=3, close=0, cells=n)).collect()} for n in (200_000, 1))
    assert len(few & many) > 0.99 * len(few)  # the rest differ in the ninth digit


def test_draws_follow_probabilities(documents):
    rows = mixing.mixed(documents, Rule(keep=0.6)).collect()
    assert len(rows) == documents.count()
    assert abs(np.mean([r["kept"] for r in rows]) - np.mean([r["p"] for r in rows])) < 0.1
    assert {r["doc_id"] for r in rows if r["kept"]} == {r["doc_id"] for r in mixing.sampled(documents, Rule(keep=0.6)).collect()}
    assert all((r["weight"] is None) != r["kept"] for r in rows)


def test_tokens_are_words_and_an_end(spark):
    texts = ["", " ", "a", " a", "a ", " a  b\n", "a\tb c", None, "\n"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mixing.tokens(mixing.words(F.col("t"))).alias("n"))
    assert [r["n"] for r in frame.collect()] == [len((t or "").split()) + 1 for t in texts]


def test_awkward_rows(awkward, nothing):
    rows = mixing.mixed(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r["topic"] for r in rows if r["doc_id"] in (3, 4, 5)} == {"empty"}
    assert {r["lang"] for r in rows if r["doc_id"] == 4} == {None}
    kept = mixing.sampled(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == sum(r["kept"] for r in rows)
    assert mixing.mixed(nothing).count() == mixing.sampled(nothing).count() == 0


def test_topics_come_from_all_documents(spark):
    """Two of 6,000 documents are of a kind of their own: both are topics then, whichever documents a hash would draw;
    idf and centres are those of all rows, and no layout changes a cluster."""
    rows = [(i, f"plain words {'river' if i % 2 else 'engine'} here", "en", "a") for i in range(6000)] + [(6000, "violin opera piano", "en", "a"), (6001, "quartz basalt granite", "en", "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r["topic"] for r in mixing.mixed(frame, Rule(topics=4)).collect()}
    assert len(set(found.values())) == 4 and len({found[i] for i in (0, 1, 6000, 6001)}) == 4
    assert {i: found[i % 2] for i in range(6000)} == {i: t for i, t in found.items() if i < 6000}
    assert found == {r["doc_id"]: r["topic"] for r in mixing.mixed(frame.orderBy(F.desc("doc_id")).repartition(3), Rule(topics=4)).collect()}


def test_clusters_against_brute_force(documents):
    """A pass over all documents moves each centre to the mean of what is nearest to it."""
    rule = Rule(topics=4, passes=1)
    seen, plainly = [], mixing._moved
    mixing._moved = lambda found, topics: seen.append((found.collect(), topics, plainly(found, topics))) or seen[-1][2]
    try:
        mixing.counted(documents, rule)
    finally:
        mixing._moved = plainly
    (rows, topics, moved), n = seen[0], documents.where("trim(text) <> ''").count()
    assert len(rows) == n and len(topics.centres) == 4
    x = np.zeros((n, rule.features))
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["at"], dtype=topics.kind)] = np.frombuffer(r["weight"], dtype=np.int32) / mixing.SCALE
    assert np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-6)
    assert np.allclose(topics.idf, np.log((n + 1) / ((x > 0).sum(axis=0) + 1)))  # no word is in all documents
    assert all(np.abs(x - c).sum(axis=1).min() < 1e-9 for c in topics.centres)  # starts are rows
    near = ((x[:, None, :] - topics.centres[None]) ** 2).sum(axis=2).round(7).argmin(axis=1)
    assert np.allclose(moved, np.stack([x[near == k].mean(axis=0) for k in range(4)]), atol=1e-8)
