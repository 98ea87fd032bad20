import json

from sessionlake import config
from sessionlake.__main__ import main
from sessionlake.functions import table_functions


def call(capsys, *args):
    code = main([str(a) for a in args])
    return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_from_logs_to_a_diff(spark, tmp_path, capsys):
    log = tmp_path / "custom" / "mine" / "a.jsonl"
    log.parent.mkdir(parents=True)
    sessions = [{"session_id": str(i), "model": "m", "messages": [{"role": "user", "content": f"mail me{i}@example.com", "timestamp": None}], "stats": {"input_tokens": 5}} for i in range(3)]
    log.write_text("\n".join(map(json.dumps, sessions)))
    settings, store = tmp_path / "c.json", f"custom={tmp_path / 'custom'}"
    code, out = call(capsys, "--config", settings, "export", "--store", store, "--output", tmp_path / "v")
    assert code == 1 and "confirm" in out["message"]
    code, out = call(capsys, "--config", settings, "config", "--redact", "long secret phrase,b", "--confirm-projects")
    assert code == 0 and out["redact"] == ["***", "long...rase"]
    assert config.load(str(settings))["redact"] == ["b", "long secret phrase"]
    code, out = call(capsys, "--config", settings, "list", "--store", store)
    assert [(p["name"], p["sessions"], p["excluded"]) for p in out["projects"]] == [("mine", 3, False)]
    code, out = call(capsys, "--config", settings, "export", "--store", store, "--output", tmp_path / "v1")
    assert (code, out["sessions"]) == (0, 3) and "3 sessions, 15 input tokens" in out["card"]
    assert "example.com" not in "".join(r["value"] for r in spark.read.text(str(tmp_path / "v1")).collect())
    code, out = call(capsys, "review", tmp_path / "v1", "--full-name", "mail")
    assert (out["sessions"], out["name_matches"], out["blocks"], out["confirmed"]) == (3, 3, ["full_name"], False)
    log.write_text("\n".join(map(json.dumps, sessions[1:])))
    call(capsys, "--config", settings, "export", "--store", store, "--output", tmp_path / "v2")
    code, out = call(capsys, "merge", tmp_path / "v1", tmp_path / "v2", tmp_path / "v3")
    assert (code, out["carried_forward"], out["written"]) == (0, 1, False)
    code, out = call(capsys, "diff", tmp_path / "v1", tmp_path / "v2", tmp_path / "d")
    assert (out["removed"], out["unchanged_records"]) == (1, 2)
    assert call(capsys, "yaml", tmp_path / "v2", tmp_path / "y")[0] == 0
    code, out = call(capsys, "merge", tmp_path / "v1", tmp_path / "none", tmp_path / "v4")
    assert code == 1


def test_from_a_review_to_a_push(spark, tmp_path, capsys):
    data, settings = tmp_path / "v1", tmp_path / "c.json"
    data.mkdir()
    (data / "a.jsonl").write_text("\n".join(json.dumps({"session_id": str(n), "source": "custom", "project": "p", "model": "m", "messages": [{"role": "user", "content": f"text {n}"}]}) for n in range(25)))
    run = lambda *args: call(capsys, "--config", settings, *args)
    run("config", "--username", "ann", "--source", "custom", "--confirm-projects")
    assert run("status")[1]["stage"] == "review" and run("confirm", data)[0] == 1
    said = ("--attest-asked-full-name", "I asked for the full name and scanned for Ann Lee", "--attest-asked-sensitive", "I asked about company names and none had to be redacted", "--attest-manual-scan", "I did a manual scan of 20 sessions of all kinds")
    code, out = run("review", data, "--full-name", "Ann Lee", *said)
    assert code == 0 and out["passed"], out
    assert run("confirm", data)[1]["confirmed"]["sessions"] == 25
    assert run("status", "--path", data)[1] | {"confirmed": 0} == {"stage": "confirmed", "confirmed": 0, "unchanged": True}
    approved = ("--approved", "the user approved to publish this dataset")
    assert run("push", tmp_path / "repo", data)[0] == 1
    # Other files and another order are the same data; another byte is not.
    lines = (data / "a.jsonl").read_text().split("\n")
    (data / "a.jsonl").write_text("\n".join(lines[::-1][:12]))
    (data / "b.jsonl").write_text("\n".join(lines[::-1][12:]))
    code, out = run("push", tmp_path / "repo", data, *approved)
    assert (code, out["version"], out["added"]) == (0, 1, 25)
    assert run("status", "--path", data)[1]["stage"] == "done"
    (data / "b.jsonl").write_text("\n".join(lines[::-1][12:]).replace("text 1", "text one"))
    assert run("status", "--path", data)[1] | {"confirmed": 0} == {"stage": "review", "confirmed": 0, "unchanged": False}
    assert run("push", tmp_path / "repo", data, *approved)[0] == 1 and run("confirm", data)[0] == 1


def test_hours_between_runs():
    every = lambda hours: config.interval({"sync_hours": hours})
    assert [every(h) for h in (None, "x", True, 0.2, 6, 1e9)] == ["86400 seconds", "86400 seconds", "86400 seconds", "3600 seconds", "21600 seconds", "2592000 seconds"]


def test_damaged_settings_give_defaults(tmp_path):
    (tmp_path / "c").write_text("{")
    assert config.load(str(tmp_path / "c")) == config.DEFAULTS == config.load(str(tmp_path / "none"))


def test_table_functions(spark):
    table_functions.register(spark)
    text = "me@y.org and aB3dE6gH9jK2mN5pQ8rS1tU4wX7yZ0c at 10.0.0.1 noreply@x.com"
    spark.createDataFrame([(text,), (None,)], "text string").createOrReplaceTempView("lines")
    assert sorted(r["match"] for r in spark.sql("select t.* from lines, lateral pii_matches(text) t").collect()) == ["10.0.0.1", "me@y.org"]
    assert [r["entropy"] for r in spark.sql("select t.* from lines, lateral high_entropy(text) t").collect()] == [4.95]
