"""The plans a user runs: export, review, merge, publish, diff."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.json_values import canonical_udf
from ..operators import diff as compare
from ..operators import gates, integrity, merge, redact, scans
from ..sinks import jsonl
from ..sinks.versions import Versions
from ..sources import files, selected, sqlite


def read(spark: SparkSession, stores: dict[str, str], thinking: bool = True, projects: list[str] | None = None) -> DataFrame:
    """The sessions of several sources (source to path), one table; of some ``projects`` only, or of all. Where a source
    can tell a log's project without reading it, no other project's logs are read."""
    out = None
    for source, path in stores.items():
        if source in sqlite.READERS:
            one = sqlite.READERS[source](spark, path, thinking)
        elif projects is not None and source in selected.SOURCES:
            one = selected.logs(spark, source, path, projects, thinking)
        else:
            one = files.read(spark, source, path, thinking)
        one = one if projects is None else one.where(F.col("project").isin(*projects))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no source given")
    return out


def export(sessions: DataFrame, username: str = "", extra: tuple[str, ...] = (), custom: tuple[str, ...] = (), excluded: tuple[str, ...] = (), source: str = "auto", scorer: redact.Scorer | None = None) -> DataFrame:
    """Sessions with a model, without excluded projects, redacted and stamped, copies of gemini sessions once: columns
    of :func:`jsonl.lines` and redactions."""
    kept = gates.without_projects(gates.with_model(gates.with_default_model(gates.of_source(sessions, source))), list(excluded))
    rows = jsonl.lines(kept.where(F.size("messages") > 0))
    policy = redact.policy_version(custom, (username, *extra), scorer is not None)
    rows = redact.redact_sessions(rows, "line", policy, username, extra, custom, scorer)
    # A gemini session found under several projects is one: the first by project and time stays.
    copy = F.when(F.col("source") == "gemini", F.sha2(F.regexp_replace("line", r'"project":(?:"(?:[^"\\]|\\.)*"|null),', ""), 256)).otherwise(F.sha2(F.concat_ws("\x1f", "source", "session_id", "project", "start_time", "line"), 256))
    return merge.first_seen(rows.withColumn("_copy", copy), "_copy", ["project", "start_time", "session_id"]).drop("_copy")


@dataclass
class Review:
    sessions: int
    pii: dict[str, list[str]]
    high_entropy: list[dict]
    name_matches: int
    name_examples: list[dict]
    blocks: list[str]


def review(lines: DataFrame, full_name: str | None = None, prior: int | None = None, accepted: tuple[str, ...] = ()) -> Review:
    """What is left in an export (columns line, n) that someone should look at, and the gates that it does not pass."""
    total = lines.count()
    pii = {r["kind"]: list(r["matches"]) for r in scans.pii_summary(lines.select("line"), "line").collect()}
    entropy = [r.asDict() for r in scans.high_entropy(lines, "line", "n").collect()]
    named = scans.name_lines(lines, "line", full_name) if full_name else lines.where("false")
    matches = named.count()
    examples = [r.asDict() for r in scans.occurrences(named, "line", "", "n").collect()] if matches else []
    return Review(total, pii, entropy, matches, examples, gates.review_blocks(matches, prior, total, False, accepted))


def _records(spark: SparkSession, path: str, missing_is_empty: bool) -> tuple[DataFrame, DataFrame]:
    try:
        good, bad = jsonl.parsed(spark, path)
    except AnalysisException as e:
        # A path that is not there is an empty dataset; anything else that fails must not look like one.
        if not missing_is_empty or "PATH_NOT_FOUND" not in str(e):
            raise
        empty = spark.createDataFrame([], "line string")
        keys = "line string, session_id string, source string, project string, start_time string, end_time string, model string, redaction_policy string, n_messages int"
        good, bad = spark.createDataFrame([], keys), empty
    canonical = canonical_udf("line")
    rows = good.withColumn("canonical", canonical).withColumn("n_bytes", F.octet_length("canonical").cast("long")).withColumn("digest", F.sha2("canonical", 256))
    key = merge.merge_key(F.col("source"), F.col("session_id"), F.col("project"), F.col("start_time"))
    return rows.withColumn("key", key).withColumn("order", F.col("digest")), bad


def merged(spark: SparkSession, remote: str, local: str) -> tuple[DataFrame, DataFrame]:
    """The union of two datasets of JSON lines, keep-best by session (merge_class, line canonical), and the lines that
    are no records, each once and verbatim. Unknown fields survive: records are only carried, never rebuilt."""
    old, old_bad = _records(spark, remote, missing_is_empty=True)
    new, new_bad = _records(spark, local, missing_is_empty=False)
    columns = ["key", "canonical", "n_messages", "n_bytes", "end_time", "order", "digest", "source", "session_id"]
    out = merge.union_merge(old.select(columns), new.select(columns), line="order")
    merge.publishable(out.count(), old.select("key").distinct().count())
    return out.withColumnRenamed("canonical", "line"), old_bad.union(new_bad).distinct()


def publish(spark: SparkSession, remote: str, local: str, target: str) -> dict:
    """Write the merge of ``remote`` and ``local`` to ``target``, a new path; nothing where it changes nothing."""
    out, bad = merged(spark, remote, local)
    stats = merge.merge_stats(out).first().asDict()
    if not stats["added"] and not stats["updated"]:
        return stats | {"written": False}
    lines = out.select("position", "line").unionByName(bad.select(F.struct(F.lit(2).alias("side"), F.col("line").alias("order")).alias("position"), "line"))
    jsonl.write(lines, "line", ["position"], target)
    return stats | {"written": True}


def push(spark: SparkSession, repo: str, local: str, attempts: int = 5) -> dict:
    """Merge ``local`` into the latest version of ``repo`` and commit the result as the next one. Where another writer
    committed meanwhile, the merge is made again with what they wrote, up to ``attempts`` times, so no session of either
    is lost. Nothing is written where the merge changes nothing. Returns the counts of the merge, version and written.

    The manifest keeps the data's hash (:mod:`sessionlake.operators.integrity`), so that a reader can check the data and
    equal data is known without reading it."""
    versions, told = Versions(spark, repo), {}

    def make(parent: int, now: dict) -> dict | None:
        nonlocal told
        remote = now.get("data", f"{versions.root}/none")
        target = versions.new_folder("data")
        told = publish(spark, remote, local, target)
        if not told["written"]:
            return None
        found = content_tree(spark, target)
        total = told["total"]
        return {"data": target, "hash": integrity.root(found), "sessions": total, "merge": {k: told[k] for k in ("added", "updated", "carried_forward", "unchanged")}}

    version, _ = versions.change(make, attempts)
    return told | {"version": version}


def content_tree(spark: SparkSession, path: str) -> DataFrame:
    """The hash tree of a dataset of JSON lines, keyed by line: whatever files and order they are in."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return integrity.tree(integrity.leaves(rows, "value", F.sha2("value", 256)))


def content_hash(spark: SparkSession, path: str) -> str | None:
    """A dataset's hash, whatever files and order its lines are in; None where it has none."""
    return integrity.root(content_tree(spark, path))


def verify(spark: SparkSession, repo: str) -> bool:
    """Whether the latest version's data still has the hash that was committed."""
    _, now = Versions(spark, repo).latest()
    return not now or content_hash(spark, now["data"]) == now["hash"]


def diff(spark: SparkSession, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Change events between two datasets of JSON lines with the patch of each modified record, and a row of counts.
    Raises ValueError where a line is no JSON object: what cannot be compared must not look unchanged."""
    from ..functions.json_values import patch_udf

    def rows(path: str) -> DataFrame:
        good, bad = _records(spark, path, missing_is_empty=False)
        if wrong := bad.limit(3).collect():
            raise ValueError(f"{path}: not a JSON object: " + "; ".join(r["line"][:80] for r in wrong))
        identity = F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("\x00")) for c in ("source", "project", "session_id", "start_time")])
        masked = F.regexp_replace("canonical", r'"originalFile":"(?:[^"\\]|\\.)*"', '"originalFile":""')
        return good.select(identity.alias("key"), F.sha2(masked, 256).alias("digest"), F.col("order").alias("line"), F.col("canonical").alias("record"))

    a, b = rows(old), rows(new)
    found = compare.events(a, b)
    before = a.select("key", F.col("line").alias("removed_line"), F.col("record").alias("old")).dropDuplicates(["key", "removed_line"])
    after = b.select("key", F.col("line").alias("added_line"), F.col("record").alias("new")).dropDuplicates(["key", "added_line"])
    out = found.join(before, ["key", "removed_line"], "left").join(after, ["key", "added_line"], "left")
    return out.withColumn("patch", F.when(F.col("event") == "modified", patch_udf("old", "new"))), compare.diff_summary(a, b)
