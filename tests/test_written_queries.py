"""Queries that write files and read them again, against plain Python over the tables."""

import hashlib

from sessionlake.plans.catalogue import QUERIES


def turns(spark, sf_dir):
    rows = [r for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect() if r["role"] in ("user", "assistant") and (r["text"] or "").strip()]
    return sorted(rows, key=lambda r: (r["conv_id"], r["turn"]))


def test_long_log_turns(spark, sf_dir):
    expected, count = [], {}
    for r in turns(spark, sf_dir):
        log = f"p{r['conv_id'] // 1000}"
        n = count[log] = count.get(log, -1) + 1
        text = r["text"].strip() if r["role"] == "assistant" else r["text"]
        expected.append((log, n, r["role"], f"{r['conv_id']}-{r['turn']}", len(text), hashlib.md5(text.encode()).hexdigest()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)  # a log is many splits
    try:
        found = sorted(tuple(r) for r in QUERIES["long_log_turns"](spark, sf_dir).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(found) > 50 and found == sorted(expected)


def test_selected_project_messages(spark, sf_dir):
    expected = {}
    for r in turns(spark, sf_dir):
        if r["conv_id"] % 9 in (1, 4, 7):
            own = expected.setdefault(f"p{r['conv_id'] % 9}", [0, 0])
            own[r["role"] == "assistant"] += 1
    found = {r["project"]: (r["user_messages"], r["assistant_messages"], r["messages"]) for r in QUERIES["selected_project_messages"](spark, sf_dir).collect()}
    assert found == {p: (u, a, u + a) for p, (u, a) in expected.items()}


def test_latest_changes_by_runs(spark, sf_dir):
    best = {}
    text = spark.read.parquet(f"{sf_dir}/client_changes.parquet").selectExpr("*", "cast(valid_at as string) as at", "cast(balance as string) as b")
    for r in text.collect():
        line = "|".join([r["op"] or "", r["segment"] or "", r["city"] or "", r["b"] or ""])
        low = -(10**9)
        rank = (r["seq"] if r["seq"] is not None else low, r["change_id"] if r["change_id"] is not None else low, r["at"] is not None, r["at"] or "")
        at = (rank, [-(r["change_id"] % 4) if r["change_id"] is not None else 0], line)
        key = None if r["client_id"] is None else str(r["client_id"])
        if key not in best or at[:2] > best[key][:2] or at[:2] == best[key][:2] and line < best[key][2]:
            best[key] = at
    found = {r["client_id"]: (r["seq"], r["change_id"], r["valid_at"], r["line"]) for r in QUERIES["latest_changes_by_runs"](spark, sf_dir).collect()}
    assert len(found) > 10 and set(found) == set(best)
    assert {k: (v[0], v[1], v[3]) for k, v in found.items()} == {k: (rank[0], rank[1], line) for k, (rank, _, line) in best.items()}
