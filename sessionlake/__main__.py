"""``python -m sessionlake``: list, config, export, review, confirm, status, merge, push, diff and yaml. Results are JSON on standard output;
errors too, with exit code 1."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .functions.scalars import format_size
from .operators import gates
from .plans import engine
from .sinks import jsonl
from .sinks.card import card
from .sinks.yaml_text import write_yaml
from .sources import files


def _stores(items: list[str]) -> dict[str, str]:
    return dict(x.split("=", 1) for x in items)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sessionlake", description=__doc__)
    p.add_argument("--config", default=os.path.expanduser("~/.sessionlake/config.json"))
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("list", "export"):
        c = sub.add_parser(name)
        c.add_argument("--store", action="append", required=True, metavar="SOURCE=PATH")
    c.add_argument("--output", required=True)
    c.add_argument("--no-thinking", action="store_true")
    c.add_argument("--all-projects", action="store_true")
    c = sub.add_parser("config")
    c.add_argument("--username")
    c.add_argument("--source")
    for name in ("redact", "redact-usernames", "exclude"):
        c.add_argument(f"--{name}")
    c.add_argument("--confirm-projects", action="store_true")
    c = sub.add_parser("review")
    c.add_argument("path")
    c.add_argument("--full-name")
    c.add_argument("--prior-sessions", type=int)
    c.add_argument("--accept", action="append", default=[])
    for name in ("asked-full-name", "asked-sensitive", "manual-scan"):
        c.add_argument(f"--attest-{name}", default="")
    c = sub.add_parser("confirm")
    c.add_argument("path")
    c = sub.add_parser("status")
    c.add_argument("--path")
    c = sub.add_parser("push")
    c.add_argument("repo")
    c.add_argument("path")
    c.add_argument("--approved", default="")
    c = sub.add_parser("merge")
    c.add_argument("remote")
    c.add_argument("local")
    c.add_argument("target")
    for name in ("diff", "yaml"):
        c = sub.add_parser(name)
        c.add_argument("old")
        if name == "diff":
            c.add_argument("new")
        c.add_argument("output")
    return p


def _with_lines(spark: SparkSession, path: str):  # noqa: ANN202
    """Lines of a text with a number that rises within a file. It is taken at the scan, before any shuffle."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("n"))


def run(args: argparse.Namespace, spark: SparkSession) -> dict:
    settings = config.load(args.config)
    if args.command == "config":
        new = dict(settings)
        for key in ("username", "source"):
            new[key] = getattr(args, key) or new[key]
        for key, option in (("redact", args.redact), ("usernames", args.redact_usernames), ("excluded", args.exclude)):
            new[key] = config.merged_list(new[key], option or "")
        new["projects_confirmed"] = args.confirm_projects or new["projects_confirmed"]
        config.save(args.config, new)
        return config.masked(new)
    if args.command == "list":
        rows = files.catalogs(spark, _stores(args.store))
        rows = rows.select(F.col("project").alias("name"), F.col("session_count").alias("sessions"), format_size(F.col("total_size_bytes")).alias("size"), F.col("project").isin(*settings["excluded"]).alias("excluded"), "source")
        return {"projects": [r.asDict() for r in rows.collect()]}
    if args.command == "export":
        if not settings["projects_confirmed"] and not args.all_projects:
            raise ValueError("confirm the projects first: config --confirm-projects, or export with --all-projects")
        sessions = engine.read(spark, _stores(args.store), not args.no_thinking)
        lines = engine.export(sessions, settings["username"], tuple(settings["usernames"]), tuple(settings["redact"]), tuple(settings["excluded"]), settings["source"] or "auto")
        jsonl.write(lines, "line", ["source", "project", "start_time", "session_id"], args.output)
        good, _ = jsonl.parsed(spark, args.output)
        tokens = lambda k: F.coalesce(F.get_json_object("line", f"$.stats.{k}").cast("long"), F.lit(0)).alias(k)
        return {"sessions": good.count(), "card": card(good.select("model", "project", tokens("input_tokens"), tokens("output_tokens")), os.path.basename(args.output))}
    if args.command == "review":
        found = engine.review(_with_lines(spark, args.path), args.full_name, args.prior_sessions, tuple(args.accept))
        errors = gates.attestation_errors(args.attest_asked_full_name, args.attest_asked_sensitive, args.attest_manual_scan, args.full_name, not args.full_name)
        reviewed = {"hash": engine.content_hash(spark, args.path), "sessions": found.sessions} if not errors and not found.blocks else None
        if reviewed or settings.get("reviewed"):
            config.save(args.config, {**settings, "reviewed": reviewed, "confirmed": None})
        return {**vars(found), "attestation_errors": errors, "passed": bool(reviewed), "confirmed": bool(reviewed)}
    if args.command == "confirm":
        if not settings.get("reviewed") or settings["reviewed"]["hash"] != engine.content_hash(spark, args.path):
            raise ValueError("the data is not what a review passed: review it first")
        config.save(args.config, {**settings, "confirmed": settings["reviewed"]})
        return {"confirmed": settings["reviewed"]}
    if args.command == "status":
        kept = settings["confirmed"]
        same = bool(kept) and args.path is not None and kept["hash"] == engine.content_hash(spark, args.path)
        state = {**settings, "user": settings["username"], "confirmed": kept if args.path is None or same else None}
        return {"stage": gates.stage(state), "confirmed": kept, "unchanged": same if args.path is not None else None}
    if args.command == "push":
        if problem := gates.publish_error(args.approved):
            raise ValueError(f"--approved {problem}")
        if not settings["confirmed"] or settings["confirmed"]["hash"] != engine.content_hash(spark, args.path):
            raise ValueError("the data changed since it was confirmed, or never was")
        told = engine.push(spark, args.repo, args.path)
        config.save(args.config, {**settings, "published": told["version"]})
        return told
    if args.command == "merge":
        return engine.publish(spark, args.remote, args.local, args.target)
    if args.command == "diff":
        events, counts = engine.diff(spark, args.old, args.new)
        head = counts.first().asDict()
        write_yaml(events.select("key", "n", F.to_json(F.struct("event", "key", "removed_digest", "added_digest", "patch")).alias("j")), "j", ["key", "n"], args.output)
        return head
    write_yaml(_with_lines(spark, args.old), "line", ["n"], args.output)
    return {"written": args.output}


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("sessionlake").getOrCreate()
    try:
        print(json.dumps(run(args, spark), default=str))
        return 0
    except Exception as e:  # the command line's contract: errors are JSON
        print(json.dumps({"error": type(e).__name__, "message": str(e)[:2000], "command": args.command}))
        return 1


if __name__ == "__main__":
    sys.exit(main())
