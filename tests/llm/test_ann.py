import numpy as np
import pytest

from sessionlake.llm import ann


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = [(-float(sum(a * b for a, b in zip(x[ids.index(q)], v))), i) for i, v in zip(ids, x) if i != q]
        out[q] = [i for _, i in sorted(s)[:k]]
    return out


@pytest.fixture(scope="module")
def embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def test_recall_and_scores(embeddings):
    rows = embeddings.select("vec_id", "embedding").collect()
    ids, x = [r[0] for r in rows], [r[1] for r in rows]
    found = ann.search(embeddings, embeddings.where("vec_id % 20 = 0")).collect()
    exact = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert abs(r["score"] - np.dot(np.float64(x[ids.index(r["query_id"])]), np.float64(x[ids.index(r["vec_id"])]))) < 1e-12
    assert set(got) == set(exact)
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21))
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(rows, rows[1:]))
    assert np.mean([len({v for _, v, _ in got[q]} & set(exact[q])) / 20 for q in exact]) >= 0.9


def test_all_parts_probed_is_exact_with_ties_and_small_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    x[100:180] = x[3]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    rule = ann.Rule(sample=200, parts=5, probes=5, block=40, epochs=3)
    found = ann.search(frame, frame.where("vec_id % 20 = 0"), 20, rule).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute(list(range(300)), x.tolist(), range(0, 300, 20), 20)


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(1)
    x = ann.unit(np.repeat(rng.normal(size=(6, 8)), 50, axis=0) + 0.1 * rng.normal(size=(300, 8)))
    graph = ann.neighbour_graph(x, 5)
    label = ann.balanced_partition(x, graph, 6, 0)
    assert np.bincount(label).tolist() == [50] * 6
    assert (label[np.repeat(np.arange(300), 5)] == label[graph.reshape(-1)]).mean() > 0.6


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (120, []), (140, [1.0, 1.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (None, [1.0, 1.0]), (2, [0.5, 0.5])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    found = ann.search(frame, frame.where("vec_id % 20 = 0"), 20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.search(frame.where("false"), frame.where("false")).count() == 0
