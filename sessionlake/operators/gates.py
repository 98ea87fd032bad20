"""Filters of an export and the gates that hold up a publication."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_MODELS

LEAST_CHARS = 24
LEAST_SESSIONS = 20


def with_model(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.coalesce(F.col("model"), F.lit("")).isin("", "<synthetic>") == F.lit(False))


def with_default_model(sessions: DataFrame) -> DataFrame:
    fill = F.lit(None).cast("string")
    for source, model in DEFAULT_MODELS.items():
        fill = F.when(F.col("source") == source, model).otherwise(fill)
    return sessions.withColumn("model", F.coalesce(F.when(F.col("model") != "", F.col("model")), fill))


def of_source(sessions: DataFrame, source: str) -> DataFrame:
    return sessions if source in ("all", "both", "auto") else sessions.where(F.col("source") == source)


def without_projects(sessions: DataFrame, excluded: list[str]) -> DataFrame:
    return sessions.where(~F.coalesce(F.col("project"), F.lit("")).isin(*excluded)) if excluded else sessions


def by_stamp(current: Column, kept: Column, redone: Column) -> Column:
    """Records stamped with the current policy stay as they are."""
    return F.when(F.col("redaction_policy") == current, kept).otherwise(redone)


def shrunk(prior: Column, now: Column) -> Column:
    """Any loss blocks a dataset of up to 20 sessions, five percent or more a larger one."""
    return F.when(now >= prior, False).when(prior <= 20, True).otherwise((prior - now) / prior >= 0.05)


def drifted(before: Column, after: Column) -> Column:
    """The set of redacted strings differs and is smaller than it was."""
    return (F.array_sort(F.array_distinct(before)) != F.array_sort(F.array_distinct(after))) & (F.size(F.array_distinct(after)) < F.size(F.array_distinct(before)))


def _text(value: object) -> str:
    return re.sub(r"\s+", " ", str(value or "")).strip()


def attestation_errors(full_name_said: object, sensitive_said: object, manual_said: object, full_name: str | None = None, skipped: bool = False) -> dict[str, str]:
    """What is missing from a reviewer's three statements; empty where nothing is."""
    errors, name, sensitive, manual = {}, _text(full_name_said).lower(), _text(sensitive_said).lower(), _text(manual_said).lower()
    if len(name) < LEAST_CHARS:
        errors["asked_full_name"] = "too short"
    elif skipped:
        if "full name" not in name or not any(w in name for w in ("skip", "declined", "opt out", "prefer not")):
            errors["asked_full_name"] = "must say that the full name was skipped or declined"
    elif "ask" not in name or "scan" not in name:
        errors["asked_full_name"] = "must say that the user was asked and the export scanned"
    elif not all(w in name for w in (full_name or "").lower().split() if len(w) > 1):
        errors["asked_full_name"] = "must name the full name that was scanned for"
    if len(sensitive) < LEAST_CHARS:
        errors["asked_sensitive_entities"] = "too short"
    elif "ask" not in sensitive or not any(w in sensitive for w in ("company", "client", "internal", "url", "domain", "tool", "name")) or not any(w in sensitive for w in ("no", "redact", "added", "updated", "configured")):
        errors["asked_sensitive_entities"] = "must say what was asked and what came of it"
    counts = [int(x) for x in re.findall(r"\d+", manual)]
    if len(manual) < LEAST_CHARS:
        errors["manual_scan_done"] = "too short"
    elif "manual" not in manual or "scan" not in manual:
        errors["manual_scan_done"] = "must mention a manual scan"
    elif max(counts, default=0) < LEAST_SESSIONS:
        errors["manual_scan_done"] = f"must give a count of at least {LEAST_SESSIONS} sessions"
    return errors


def publish_error(said: object) -> str | None:
    text = _text(said).lower()
    if len(text) < LEAST_CHARS:
        return "too short"
    return None if "approv" in text and ("publish" in text or "push" in text) else "must say that publishing was approved"


def acceptance_error(said: object) -> str | None:
    return None if len(_text(said)) >= LEAST_CHARS else "too short"


def same_file(size: int, digest: str, confirmed_size: int, confirmed_digest: str) -> bool:
    return size == confirmed_size and digest == confirmed_digest


#: The stages of an export, in order.
STAGES = ("auth", "configure", "review", "confirmed", "done")


def stage(state: dict) -> str:
    """Where an export stands: the first stage whose condition does not hold yet."""
    if not state.get("user"):
        return "auth"
    if not state.get("source") or not state.get("projects_confirmed"):
        return "configure"
    if not state.get("confirmed"):
        return "review"
    return "done" if state.get("published") else "confirmed"


def review_blocks(name_matches: int, prior: int | None, now: int, drift: bool, accepted: tuple[str, ...] = ()) -> list[str]:
    """The gates that hold up a confirmation, in their order: name, shrink, drift."""
    shrink = prior is not None and now < prior and (prior <= 20 or (prior - now) / prior >= 0.05)
    found = [("full_name", name_matches > 0), ("session_shrink", shrink), ("redaction_drift", drift)]
    return [name for name, hit in found if hit and name not in accepted]
