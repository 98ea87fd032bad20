import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from sessionlake.llm import sharding


def check(rows, n=8):
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min([counts.get(i, 0) for i in range(n)]) <= 1
    for i in range(n):
        assert sorted(r["slot"] for r in rows if r["shard"] == i) == list(range(counts.get(i, 0)))


def test_documents(documents, texts):
    rows = sharding.sharded(documents).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    check(rows)
    homes = defaultdict(set)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        homes[raw].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())


def test_a_group_larger_than_a_shard_is_split_no_more_than_it_must(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 2}" if i % 3 == 1 else f"t{i}") for i in range(960)]
    found = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(found)
    hot = Counter(r["shard"] for r in found if r["doc_id"] % 3 == 0)
    assert max(hot.values()) > 80  # 40 of them are in each shard at first


def test_cut_links_fall_each_round(spark):
    rows = spark.range(400).select("id", F.when(F.col("id") < 320, F.col("id") % 40).alias("hub"))
    found, log = sharding.shards(rows, 8)
    assert [x["cut"] for x in log] == sorted((x["cut"] for x in log), reverse=True) and log[-1]["cut"] < log[0]["cut"] / 3
    assert set(Counter(r["shard"] for r in found.collect()).values()) == {50}


def test_quotas_keep_counts():
    rng = np.random.default_rng(0)
    for _ in range(200):
        asked, free = rng.integers(0, 9, (5, 5)), rng.integers(0, 6, 5)
        np.fill_diagonal(asked, 0)
        granted, back = sharding.quotas(asked, free)
        assert (granted <= asked).all() and (granted >= 0).all() and (back.sum(axis=1) <= free).all()
        flow = granted + back
        assert (flow.sum(axis=0) == flow.sum(axis=1)).all()


def test_awkward_rows(awkward, nothing):
    rows = sharding.sharded(awkward).collect()
    assert len(rows) == awkward.count()
    check(rows)
    assert {r["size"] for r in rows if r["doc_id"] == 3} == {1}
    assert sharding.sharded(nothing).count() == 0


def test_same_result_again(documents):
    assert {tuple(r) for r in sharding.sharded(documents).collect()} == {tuple(r) for r in sharding.sharded(documents.repartition(5)).collect()}
