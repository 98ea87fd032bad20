import json
import os

from pyspark.sql import functions as F

from sessionlake.streaming import pairing, upsert, windows


def run(frame, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return frame.sparkSession.table(name)


def stream(spark, path, schema, batches):
    for i, b in enumerate(batches):
        (path / f"{i}.json").write_text("\n".join(map(json.dumps, b)))
        os.utime(path / f"{i}.json", (1_700_000_000 + 60 * i,) * 2)  # files are read in order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))


def test_late_rows_are_dropped_and_the_rest_is_as_on_a_table(spark, tmp_path):
    t = lambda h, m=0: f"2026-01-01 {h:02d}:{m:02d}:00"
    # A batch is judged by the watermark of the one before: what comes late comes a batch after it has moved.
    batches = [[{"ts": t(1), "k": "a"}, {"ts": t(1, 30), "k": "a"}], [{"ts": t(5), "k": "b"}], [{"ts": t(9), "k": "c"}], [{"ts": t(1, 10), "k": "late"}], [{"ts": t(20), "k": "d"}]]
    frame = stream(spark, tmp_path, "ts timestamp, k string", batches)
    out = run(windows.tumbling(frame, "ts", "1 hour", ["k"], F.count("*").alias("n")), "tumbled")
    assert sorted((r["k"], r["n"]) for r in out.collect()) == [("a", 2), ("b", 1), ("c", 1)]
    table = spark.read.schema("ts timestamp, k string").json(str(tmp_path))
    assert windows.tumbling(table, "ts", "1 hour", ["k"], F.count("*").alias("n")).count() == 5


def test_distinct_within_the_watermark(spark, tmp_path):
    rows = [{"ts": "2026-01-01 01:00:00", "k": "a"}, {"ts": "2026-01-01 01:05:00", "k": "a"}, {"ts": "2026-01-01 01:06:00", "k": "b"}]
    frame = stream(spark, tmp_path, "ts timestamp, k string", [rows[:2], rows[1:]])
    assert sorted(r["k"] for r in run(windows.distinct_within(frame, ["k"], "ts"), "once").collect()) == ["a", "b"]
    table = spark.read.schema("ts timestamp, k string").json(str(tmp_path))
    assert windows.distinct_within(table, ["k"], "ts").count() == 2


def test_calls_and_results_pair_in_either_order(spark, tmp_path):
    row = lambda i, kind, p: {"call_id": i, "kind": kind, "payload": p}
    frame = stream(spark, tmp_path, "call_id string, kind string, payload string", [[row("1", "call", "a"), row("2", "result", "y")], [row("1", "result", "x"), row("2", "call", "b")], [row("3", "call", "c")]])
    assert sorted(map(tuple, run(pairing.paired(frame), "paired").collect())) == [("1", "a", "x"), ("2", "b", "y")]


def test_upserts(spark, tmp_path):
    schema = "key string, n_messages int, n_bytes long, end_time string, line long, digest string"
    row = lambda k, n, line: {"key": k, "n_messages": n, "n_bytes": 1, "end_time": "t", "line": line, "digest": "d"}
    (tmp_path / "in").mkdir()
    frame = stream(spark, tmp_path / "in", schema, [[row("a", 1, 1), row("b", 5, 2)], [row("a", 2, 1), row("b", 3, 2), row("c", 1, 3)]])
    q = upsert.merge_stream(frame, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert q.exception() is None
    assert sorted((r["key"], r["n_messages"]) for r in spark.read.parquet(str(tmp_path / "out" / "v1")).collect()) == [("a", 2), ("b", 5), ("c", 1)]
