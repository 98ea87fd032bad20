import json
import os
import shutil

import pytest

from sessionlake.streaming import tail


def drain(spark, folder, out, check, **options):
    """One run of the query on its checkpoint, over all that is there; the rows so far."""
    frame = tail.lines(spark, str(folder), **options)
    q = frame.writeStream.format("json").option("path", str(out)).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted((r["line"] or "") for r in spark.read.schema(tail.SCHEMA).json(str(out)).collect())


@pytest.fixture()
def place(tmp_path):
    (tmp_path / "logs").mkdir()
    return tmp_path / "logs", tmp_path / "out", tmp_path / "check"


def add(path, text):
    with open(path, "a", newline="") as f:
        f.write(text)


def test_appends_cuts_and_rotations_over_restarts(spark, place):
    logs, out, check = place
    log = logs / "a.jsonl"
    run = lambda: drain(spark, logs, out, check, start="earliest")
    add(log, "one\ntwo\r\n\nthr")
    (logs / "other.txt").write_text("not a log\n")
    seen = ["", "one", "two"]
    assert run() == seen  # the line being written waits
    assert run() == seen
    add(log, "ee\nfour\n")
    seen = sorted([*seen, "three", "four"])
    assert run() == seen
    # Renamed with lines unread, and a new file under the old name.
    add(log, "five\n")
    os.rename(log, logs / "a.jsonl.1")
    add(log, "six\n")
    seen = sorted([*seen, "five", "six"])
    assert run() == seen
    # Renamed again: both go on where they were.
    os.rename(logs / "a.jsonl.1", logs / "a.jsonl.2")
    os.rename(log, logs / "a.jsonl.1")
    add(logs / "a.jsonl.1", "seven\n")
    add(log, "eight\n")
    seen = sorted([*seen, "seven", "eight"])
    assert run() == seen
    # Cut and written anew, shorter than before; then longer than before.
    log.write_text("9\n")
    seen = sorted([*seen, "9"])
    assert run() == seen
    log.write_text("a much longer line than all before\n")
    seen = sorted([*seen, "a much longer line than all before"])
    assert run() == seen
    # Copied with an unread line, then cut.
    add(log, "ten\n")
    shutil.copy(log, logs / "a.jsonl.9")
    log.write_text("eleven\n")
    seen = sorted([*seen, "ten", "eleven"])
    assert run() == seen
    (logs / "a.jsonl.2").unlink()
    assert run() == seen


def test_from_now_on(spark, place):
    logs, out, check = place
    add(logs / "a.jsonl", "old\nhalf")
    frame = tail.lines(spark, str(logs))
    q = frame.writeStream.format("memory").queryName("tailed").start()
    try:
        q.processAllAvailable()
        add(logs / "a.jsonl", " done\nnew\n")
        add(logs / "b.jsonl", "another\n")
        q.processAllAvailable()
        assert sorted(r["line"] for r in spark.table("tailed").collect()) == ["another", "half done", "new"]
    finally:
        q.stop()


@pytest.mark.parametrize("size", ["1", "7", "100000"])
def test_pieces_share_no_line(spark, place, size):
    logs, out, check = place
    texts = [json.dumps({"n": n, "t": "é" * (n % 50)}, ensure_ascii=False) for n in range(300 if size != "1" else 20)]
    add(logs / "a.jsonl", "".join(f"{t}\n" for t in texts))
    assert drain(spark, logs, out, check, start="earliest", bytes=size) == sorted(texts)
    rows = spark.read.schema(tail.SCHEMA).json(str(out)).collect()
    raw = (logs / "a.jsonl").read_bytes()
    assert all(raw[r["position"] :].startswith(r["line"].encode()) for r in rows)


def test_no_folder_yet(spark, tmp_path):
    assert drain(spark, tmp_path / "none", tmp_path / "out", tmp_path / "check", start="earliest") == []
