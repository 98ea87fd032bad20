import hashlib
import zlib

import pytest

from sessionlake.llm import merkle
from sessionlake.llm.queries import QUERIES

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The node that remains, and for each leaf the (place in its run, run) of every level."""
    ways = [[] for _ in nodes]
    spans = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
        for i, span in enumerate(spans):
            for leaf in span:
                ways[leaf].append((i % 2, runs[i // 2]))
        spans = [sum(spans[i : i + 2], []) for i in range(0, len(spans), 2)]
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], ways


def expected(rows):
    rows = [r.asDict() for r in rows]
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"], leaf_of(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for g in order}
    climbed = {g: climb([x[1] for x in trees[g]]) for g in order}
    root, over = climb([climbed[g][0] for g in order]) if order else (None, [])
    out = []
    for n, g in enumerate(order):
        subroot, ways = climbed[g]
        for (doc, leaf, r), way in zip(trees[g], ways):
            way = way + over[n]
            proof = sha("".join("".join(x for k, x in enumerate(run) if k != place) for place, run in way))
            changed = doc is not None and r["n_chars"] is not None and zlib.crc32(str(doc).encode()) % 7 == 0
            now = leaf_of(r, 1) if changed else leaf
            for place, run in way:
                now = sha("".join(now if k == place else x for k, x in enumerate(run)))
            out.append((doc, leaf, subroot, root, proof, now, now == root))
    return out


def same(found, rows):
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected(rows), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 129, 4097])
def test_one_language_of_every_size(spark, n):
    docs = spark.range(n).selectExpr("id * 3 as doc_id", "'s' as source", "'en' as lang", "id as n_chars", "concat('text ', id) as text")
    same(merkle.documents(docs), docs.collect())


def test_many_languages(spark):
    docs = spark.range(600).selectExpr("id as doc_id", "'s' as source", "if(id % 150 = 0, null, concat('l', cast(sqrt(id * 6) as int))) as lang", "if(id % 5 = 0, null, id) as n_chars", "'x' as text")
    same(merkle.documents(docs), docs.collect())


def test_the_query(spark, sf_dir, documents):
    found = QUERIES["op13_merkle"](spark, sf_dir)
    same(found, documents.collect())
    rows = found.collect()
    assert any(not r["verified"] for r in rows) and all(r["verified"] or zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 for r in rows)


def test_awkward_rows(spark, awkward, nothing):
    same(merkle.documents(awkward), awkward.collect())
    assert merkle.documents(nothing).collect() == []


def test_no_group_is_gathered(spark, documents):
    """A block holds at most 64 nodes, whatever the languages' sizes."""
    rows = spark.range(1000).selectExpr("'g' as g", "1000L as n", "id as at", "sha2(cast(id as string), 256) as hash")
    found = merkle.blocks(rows).selectExpr("size(pre) as levels", "size(pre[0]) as pairs").collect()
    assert len(found) == 16 and all(r["levels"] == 6 and r["pairs"] <= 32 for r in found)
