import json
import sqlite3

from pyspark.sql import Observation
from pyspark.sql import functions as F

from sessionlake.functions import scalars
from sessionlake.sinks.card import card, metadata
from sessionlake.sources import long_logs, sqlite
from sessionlake.sources.metrics import counted
from sessionlake.streaming.progress import Progress

LINES = ['{"type": "user", "message": {"content": "x"}}', "", "  ", "not json", "[1]", "7", '{"a": 1}']


def test_counts_of_a_scan(spark, tmp_path):
    (tmp_path / "-home-ann-app").mkdir()
    (tmp_path / "-home-ann-app" / "s.jsonl").write_text("\n".join(LINES))
    seen = Observation("lines")
    found = counted(spark.read.text(str(tmp_path / "-home-ann-app")), seen)
    assert found.count() == 7 and seen.get == {"lines": 7, "blank": 2, "malformed": 1, "not_objects": 2}
    seen = Observation("again")
    sessions, messages = long_logs.read(spark, "claude", str(tmp_path), counts=seen)
    assert messages.count() == 1 and seen.get == {"lines": 7, "blank": 2, "malformed": 1, "not_objects": 2}


def test_counts_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"{n}.txt").write_text("\n".join(LINES))
    events, listener = [], None
    listener = Progress(events.append, interval=0)
    spark.streams.addListener(listener)
    try:
        stream = counted(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")), "lines")
        q = stream.writeStream.format("noop").queryName("told").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        import time

        for _ in range(100):
            if events and events[-1]["phase"] == "ended":
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert events[0]["phase"] == "started" and events[-1]["phase"] == "ended"
    assert events[-1] | {"query": ""} == {"query": "", "phase": "ended", "rows": 21, "lines.lines": 21, "lines.blank": 6, "lines.malformed": 3, "lines.not_objects": 6}
    assert sum(e["phase"] == "progress" for e in events) == 3


def test_events_are_throttled():
    events, now = [], [0.0]
    p = Progress(events.append, interval=2, clock=lambda: now[0])
    for t, rows in ((0, 5), (1, 5), (1.5, 0), (2.5, 0), (3, 1), (9, 0), (20, 0)):
        now[0] = t
        p.add("q", int(t * 10), rows, {"o": {"n": rows}})
    # At 2.5 the rows of 1 are told of, at 9 those of 3; at 20 nothing came since.
    assert [(e["rows"], e["o.n"]) for e in events] == [(5, 5), (10, 10), (11, 11)]
    p.end("q", "failed")
    assert events[-1] == {"query": "q", "phase": "ended", "rows": 11, "o.n": 11, "error": "failed"}


def test_a_store_is_opened_once_until_it_changes(tmp_path, monkeypatch):
    path, opened, real = str(tmp_path / "a.db"), [], sqlite.connect
    with sqlite3.connect(path) as c:
        c.execute("create table t (x)")
    monkeypatch.setattr(sqlite, "connect", lambda p: opened.append(p) or real(p))
    first = sqlite.snapshot(path)
    assert sqlite.snapshot(path) is first and len(opened) == 1
    with sqlite3.connect(path) as c:
        c.executemany("insert into t values (?)", [("x" * 5000,)] * 3)
    again = sqlite.snapshot(path)
    assert again is not first and again.execute("select count(*) from t").fetchone() == (3,) and len(opened) == 2


def test_metadata_and_card(spark):
    rows = [("v/Model_1", "claude:App", 5, 7), ("v/Model_1", "claude:Other", 1, 1), (None, None, 2, None), ("b", "claude:App", None, 3)]
    sessions = spark.createDataFrame(rows, "model string, project string, input_tokens long, output_tokens long")
    found = json.loads(metadata(sessions, "2026-01-01"))
    assert (found["sessions"], found["input_tokens"], found["output_tokens"]) == (4, 8, 11)
    assert found["model_breakdown"] == {"Model-1": {"sessions": 2, "input_tokens": 6, "output_tokens": 8}, "b": {"sessions": 1, "input_tokens": 0, "output_tokens": 3}}
    assert found["project_breakdown"]["app"] == {"sessions": 2, "input_tokens": 5, "output_tokens": 10}
    assert "1 more are not shown." in card(sessions, "n", most=1) and "not shown" not in card(sessions, "n")
    assert "| none | 0 | 0 | 0 |" in card(sessions.where("false"), "n")
    assert json.loads(metadata(sessions.where("false"), "t"))["sessions"] == 0


def test_emojis(spark):
    texts = ["plain", "", None, "a\U0001f600b\U0010ffff", "\U0001f600", "é\uffff", "__EMOJI_1F600__x", "__EMOJI_zz__"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.escaped_emojis(F.col("t")).alias("e"), scalars.restored_emojis(scalars.escaped_emojis(F.col("t"))).alias("r"))
    found = {r["t"]: (r["e"], r["r"]) for r in frame.collect()}
    code = lambda t: "".join(f"__EMOJI_{ord(c):x}__" if ord(c) > 0xFFFF else c for c in t)
    assert all(found[t][0] == code(t) for t in texts if t is not None) and found[None] == (None, None)
    assert all(found[t][1] == t for t in texts if t is not None and "1F600" not in t) and found["__EMOJI_1F600__x"][1] == "\U0001f600x"
