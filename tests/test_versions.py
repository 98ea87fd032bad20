import json
import threading

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionlake.operators import integrity
from sessionlake.operators.merge import union_merge
from sessionlake.plans import engine
from sessionlake.sinks.versions import Late, Versions
from sessionlake.streaming.runs import Runs, upsert_stream

SCHEMA = "key string, n_messages int, n_bytes long, end_time string, line string, digest string"


def test_one_of_many_writers_commits(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    assert versions.latest() == (0, {})
    made = []
    writers = [threading.Thread(target=lambda n=n: made.append(Versions(spark, str(tmp_path)).commit(0, {"by": n}))) for n in range(8)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(m is not None for m in made) == [False] * 7 + [True] and versions.numbers() == [1]
    assert versions.commit(0, {}) is None and versions.commit(1, {"by": "x"}) == 2
    assert versions.latest() == (2, {"by": "x", "parent": 1}) and versions.read(0) == {}


def test_a_late_writer_makes_it_again(spark, tmp_path):
    versions, seen = Versions(spark, str(tmp_path)), []

    def make(parent, now):
        seen.append(parent)
        if len(seen) < 3:
            versions.commit(parent, {"n": now.get("n", 0) + 10})  # somebody else
        return {"n": now.get("n", 0) + 1}

    assert versions.change(make) == (3, {"n": 21}) and seen == [0, 1, 2]

    def never(parent, now):
        versions.commit(parent, now)
        return now

    with pytest.raises(Late):
        versions.change(never, attempts=3)
    before = versions.latest()
    assert versions.change(lambda parent, now: None) == before


def sessions(path, rows):
    path.mkdir()
    body = [json.dumps({"session_id": s, "source": "claude", "project": "p", "start_time": "t", "end_time": "t", "model": "m", "messages": [{"role": "user", "content": str(i)} for i in range(n)]}) for s, n in rows]
    (path / "a.jsonl").write_text("\n".join(body))
    return str(path)


def held(spark, repo):
    data = Versions(spark, repo).latest()[1]["data"]
    return {json.loads(r["value"])["session_id"]: len(json.loads(r["value"])["messages"]) for r in spark.read.text(data).collect()}


def test_racing_pushes_lose_no_session(spark, tmp_path, monkeypatch):
    repo = str(tmp_path / "repo")
    one, two = sessions(tmp_path / "one", [("a", 1), ("b", 3)]), sessions(tmp_path / "two", [("b", 2), ("c", 1)])
    told = engine.push(spark, repo, one)
    assert (told["version"], told["added"], told["written"]) == (1, 2, True) and engine.verify(spark, repo)
    # Between this writer's look and its commit another one commits.
    real, others = engine.publish, [sessions(tmp_path / "three", [("d", 1)]), sessions(tmp_path / "four", [("a", 4)])]

    def slow(*args):
        out = real(*args)
        if others:
            other = others.pop()
            with monkeypatch.context() as m:
                m.setattr(engine, "publish", real)
                engine.push(spark, repo, other)
        return out

    monkeypatch.setattr(engine, "publish", slow)
    told = engine.push(spark, repo, two)
    monkeypatch.setattr(engine, "publish", real)
    assert told["version"] == 4 and held(spark, repo) == {"a": 4, "b": 3, "c": 1, "d": 1}
    again = engine.push(spark, repo, two)
    assert (again["written"], again["version"]) == (False, 4)
    assert Versions(spark, repo).vacuum() and held(spark, repo) == {"a": 4, "b": 3, "c": 1, "d": 1} and engine.verify(spark, repo)
    # A byte that changed is found.
    folder = Versions(spark, repo).latest()[1]["data"]
    rows = [r["value"] for r in spark.read.text(folder).collect()]
    spark.createDataFrame([(r.replace('"c"', '"x"'),) for r in rows], "value string").write.mode("overwrite").text(folder)
    assert not engine.verify(spark, repo)


ROW = st.tuples(st.sampled_from("abcdef"), st.integers(1, 3), st.integers(1, 2), st.sampled_from([None, "t1", "t2"]), st.integers(0, 99))


@given(st.lists(st.lists(ROW, max_size=5), min_size=1, max_size=6))
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_runs_hold_what_the_merges_hold(spark, tmp_path_factory, batches):
    runs = Runs(spark, str(tmp_path_factory.mktemp("runs")), SCHEMA, fan=2)
    expected = spark.createDataFrame([], SCHEMA)
    for n, batch in enumerate(batches):
        rows = spark.createDataFrame([(k, m, b, e, f"{line:03d}", f"{n}-{i}") for i, (k, m, b, e, line) in enumerate(batch)], SCHEMA)
        runs.upsert(rows, n)
        runs.upsert(rows, n)  # repeated after a failure
        runs.compact()
        expected = spark.createDataFrame(union_merge(expected, rows).select(expected.columns).collect(), SCHEMA)
        kept = lambda df: sorted(map(repr, df.select("key", "n_messages", "n_bytes", "end_time").collect()))
        assert kept(runs.read()) == kept(expected)
    assert len(runs.versions.latest()[1].get("runs", [])) <= 4


def test_a_small_batch_writes_little(spark, tmp_path):
    runs = Runs(spark, str(tmp_path), SCHEMA)
    big = spark.range(50_000).selectExpr("sha2(cast(id as string), 256) as key", "1 as n_messages", "id as n_bytes", "'t' as end_time", "repeat('x', 50) as line", "'d' as digest")
    runs.upsert(big, 0)
    size = lambda r: sum(f.stat().st_size for f in (tmp_path / r["folder"].rsplit("/", 1)[-1]).glob("*.parquet"))
    first = size(runs.versions.latest()[1]["runs"][0])
    keys = [r["key"] for r in big.limit(3).collect()]
    runs.upsert(big.where(F.col("key").isin(keys)).withColumn("n_messages", F.lit(2)), 1)
    assert size(runs.versions.latest()[1]["runs"][1]) < first / 50
    assert runs.compact() == 0 and runs.read().count() == 50_000
    found = runs.get(keys)
    assert {r["n_messages"] for r in found.collect()} == {2} and found.count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(key" in plan or "PushedFilters: [Or(EqualTo" in plan or "EqualTo(key" in plan
    assert runs.may_hold(["zzz"]) == [] and runs.get(["zzz"]).collect() == []
    runs.upsert(big.where("false"), 2)
    assert len(runs.versions.latest()[1]["runs"]) == 2
    assert runs.read(1).where("n_messages = 2").count() == 0  # an earlier version


def test_a_stream_of_upserts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    runs = Runs(spark, str(tmp_path / "out"), SCHEMA, fan=2)
    for n in range(4):
        rows = [{"key": k, "n_messages": n + (k == "a"), "n_bytes": 1, "end_time": "t", "line": "l", "digest": "d"} for k in ("a", f"k{n}")]
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = upsert_stream(stream, runs, str(tmp_path / "check"))
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted((r["key"], r["n_messages"]) for r in runs.read().collect()) == [("a", 4), ("k0", 0), ("k1", 1), ("k2", 2), ("k3", 3)]
    assert [r["level"] for r in runs.versions.latest()[1]["runs"]] == [2]


def test_the_tree_does_not_know_the_layout(spark):
    rows = spark.range(3000).selectExpr("id as k", "if(id % 7 = 0, null, concat('v', id % 10)) as v").unionByName(spark.sql("select cast(null as long) as k, 'x' as v"))
    digest = integrity.row_digest(["k", "v"])
    of = lambda df: integrity.tree(integrity.leaves(df, "k", digest))
    a = of(rows)
    assert integrity.root(a) == integrity.root(of(rows.repartition(13).sort("v"))) and integrity.root(of(rows.where("false"))) is None
    changed = rows.withColumn("v", F.when(F.col("k") == 5, "other").otherwise(F.col("v")))
    assert integrity.root(of(changed)) != integrity.root(a) and len(integrity.unequal_leaves(a, of(changed))) == 1
    assert integrity.unequal_leaves(a, a) == []
    # A row twice, one less, one changed, a null against an empty text.
    more = changed.unionByName(rows.where("k = 9")).where("k is null or k <> 20").withColumn("v", F.when(F.col("k") == 14, "").otherwise(F.col("v")))
    found = {r["k"]: (r["removed"], r["added"]) for r in integrity.differences(rows, more, "k", ["k", "v"]).collect()}
    assert found == {5: (1, 1), 9: (0, 1), 20: (1, 0), 14: (1, 1)}
    assert integrity.differences(rows, rows, "k", ["k", "v"]).collect() == []
