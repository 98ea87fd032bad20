"""The settings of an export: one JSON document, read with defaults and written whole."""

from __future__ import annotations

import json
import os
import tempfile

DEFAULTS = {"source": None, "username": "", "usernames": [], "redact": [], "excluded": [], "model_filter": False, "projects_confirmed": False, "confirmed": None, "published": None}


def load(path: str) -> dict:
    """The settings over the defaults; a file that is missing or damaged gives the defaults."""
    try:
        with open(path) as f:
            found = json.load(f)
    except (OSError, ValueError):
        found = {}
    return {**DEFAULTS, **(found if isinstance(found, dict) else {})}


def save(path: str, settings: dict) -> None:
    """Written beside and renamed: readers see the old settings or the new ones."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=folder, prefix=".settings-")
    with os.fdopen(handle, "w") as f:
        json.dump(settings, f, indent=2, sort_keys=True)
    os.replace(part, path)


def merged_list(old: list[str], text: str) -> list[str]:
    """A list with the items of a comma-separated text added, sorted, each once."""
    return sorted({*old, *(x.strip() for x in text.split(",") if x.strip())})


def masked(settings: dict) -> dict:
    """The settings as they may be shown: redacted strings by their ends alone."""
    hide = lambda s: "***" if len(s) <= 8 else f"{s[:4]}...{s[-4:]}"
    return {**settings, "redact": [hide(s) for s in settings["redact"]]}


#: Hours between two runs that nobody started.
LEAST_HOURS, MOST_HOURS, USUAL_HOURS = 1.0, 720.0, 24.0


def interval(settings: dict) -> str:
    """The trigger of a stream that keeps a dataset up to date: the setting ``sync_hours``, between an hour and thirty
    days; a day where it is no number."""
    hours = settings.get("sync_hours")
    hours = hours if isinstance(hours, (int, float)) and not isinstance(hours, bool) and hours == hours else USUAL_HOURS
    return f"{round(min(max(hours, LEAST_HOURS), MOST_HOURS) * 3600)} seconds"
