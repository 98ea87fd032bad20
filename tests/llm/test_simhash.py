import itertools
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sessionlake.llm import simhash
from sessionlake.llm.components import connected_components
from sessionlake.llm.simhash import NEAR, Shape


def plain(text, words=4, bits=64, once=False):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) if bits == 64 else int.from_bytes(xxhash.xxh128_digest(g.encode(), 42), "little") for g in grams]
    h = list(set(h)) if once else h
    return sum(1 << b for b in range(bits) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, linked):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in nodes}


def test_masks_cover_every_pair_within_the_radius():
    for bits, radius in ((8, 2), (10, 3), (16, 2)):
        own = [int(m) for m in simhash.masks(bits, radius)]
        assert len(own) == 2 ** (radius + 1) - 1
        for n in range(radius + 1):
            for where in itertools.combinations(range(bits), n):
                assert any(not m & sum(1 << i for i in where) for m in own)


def test_covering_of_64_bits_on_random_pairs():
    rng, own = random.Random(1), [int(m) for m in simhash.masks(64, 4)]
    for _ in range(3000):
        difference = sum(1 << i for i in rng.sample(range(64), 4))
        assert any(not m & difference for m in own)


def test_fingerprints_and_components_against_brute_force(documents, texts):
    found = {r["doc_id"]: (r["w0"] & (2**64 - 1), r["component_id"]) for r in simhash.components(documents).collect()}
    prints = {d: plain(t) for d, t in texts.items()}
    assert {d: f for d, (f, _) in found.items()} == prints
    linked = [(a, b) for a, b in itertools.combinations(sorted(texts), 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {d: c for d, (_, c) in found.items()} == roots(sorted(texts), linked)


def test_wide_fingerprints():
    for text in ("one two three four five six seven eight", "a b c d e " * 40 + "f g h i j k l m"):
        low, high = simhash.fingerprint(text, NEAR).tolist()
        assert low | high << 64 == plain(text, 5, 128, once=True)


def test_hot_buckets_are_split_without_losing_links(spark):
    rng = np.random.default_rng(3)
    points = set()
    for _ in range(3):  # dense clouds, far from each other
        centre = int(rng.integers(0, 2**63))
        for _ in range(200):
            points.add(centre ^ sum(1 << int(i) for i in rng.choice(64, 3, replace=False)))
    nodes = sorted(points)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in nodes]
    frame = spark.createDataFrame(signed, "w0 long")
    expected = roots(nodes, [(a, b) for a, b in itertools.combinations(nodes, 2) if (a ^ b).bit_count() <= 4])
    for chunk in (20, 8192):
        edges = [(r["a0"] & (2**64 - 1), r["b0"] & (2**64 - 1)) for r in simhash.links(frame, Shape(chunk=chunk)).collect()]
        assert roots(nodes, edges) == expected  # edges are stars of what links


def test_awkward_rows(awkward, nothing):
    found = simhash.components(awkward).collect()
    assert len(found) == awkward.count()
    by = {r["doc_id"]: (r["w0"], r["component_id"]) for r in found}
    assert by[3] == by[4] == by[5] == (0, 3)
    assert by[1][1] == by[2][1] == 1 and by[9][1] == 9 and by[None][1] is None
    assert simhash.components(nothing).count() == 0


def test_one_document_of_each_group_stays(awkward, nothing):
    kept = simhash.near_duplicates_removed(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == sorted(map(str, [1, 3, 6, 7, 8, 9, 11, None]))
    assert simhash.near_duplicates_removed(nothing).count() == 0


def test_near_copies_at_similarity_of_0_8_are_found(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, copies = [], 0
    for i in range(150):
        w = [word() for _ in range(300)]
        rows.append((2 * i, " ".join(w)))
        for k in range(20, 300, 47):  # 6 changed words: 30 of 296 shingles differ, similarity 0.82
            w[k] = word()
        rows.append((2 * i + 1, " ".join(w)))
    kept = {r["doc_id"] for r in simhash.near_duplicates_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * i for i in range(150)} <= kept
    assert len(kept) <= 150 + 8


def test_connected_components_against_brute_force(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (5, 6), (5, 6)]
    nodes = sorted({x for e in edges for x in e})
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"))[0].collect()}
    expected = roots(nodes, edges)
    assert found == {n: r for n, r in expected.items() if sum(1 for x in expected.values() if x == r) > 1}
    assert connected_components(spark.createDataFrame([], "a long, b long"))[0].count() == 0


def test_a_column_named_like_ours_changes_nothing(documents):
    clash = documents.withColumn("w0", F.lit(1)).withColumn("component_id", F.lit("x")).withColumn("key", F.lit(2))
    a = {tuple(r) for r in simhash.components(clash).collect()}
    assert a == {tuple(r) for r in simhash.components(documents).collect()}
