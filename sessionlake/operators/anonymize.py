"""Pseudonyms for user names."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import user_hash

#: Fixed value: names shorter than this are searched in home paths alone. The word bounds and home folders below are fixed too.
SHORT = 4


def pseudonym(name: str) -> str:
    """The hash is of the name as it is given, here and in :func:`scalars.user_hash`; only the search ignores case."""
    return "user_" + hashlib.sha256(name.encode()).hexdigest()[:8]


def _java_quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text) if text.isascii() else r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def patterns(name: str, home: str | None = None) -> list[tuple[str, str]]:
    """(Java pattern, replacement): a whole word of four characters or more anywhere; a shorter name only as the user's
    part of a home path."""
    new, quoted = pseudonym(name), _java_quote(name)
    if len(name) >= SHORT:
        return [(rf"(?iu)(?<![a-zA-Z0-9]){quoted}(?![a-zA-Z0-9])", new)]
    out = [(rf"(?iu)([/\\-]+(?:Users|home)[/\\-]+){quoted}(?=[^a-zA-Z0-9]|$)", f"$1{new}")]
    if home and not home.startswith(("/Users/", "/home/", "C:\\Users\\")) and name.lower() in home.lower():
        lead, _, rest = home.lower().replace("\\", "/").rpartition(name.lower())
        parts = [_java_quote(p).replace(r"\:", ":?") for p in lead.split("/")]
        tail = r"[/\\-]+".join(_java_quote(p) for p in rest.split("/"))
        out.append((rf"(?iu)({r'[/\\-]+'.join(parts)}){quoted}(?={tail})", f"$1{new}"))
    return out


def anonymize(text: Column, username: str, extra: tuple[str, ...] = (), home: str | None = None) -> Column:
    """The user's own name first, then further ones, longest first."""
    for pattern, new in patterns(username, home) if username else []:
        text = F.regexp_replace(text, pattern, new)
    for name in sorted({x.strip().lower() for x in extra if len(x.strip()) >= SHORT}, key=lambda x: (-len(x), x)):
        text = F.regexp_replace(text, rf"(?iu)(?<![a-zA-Z0-9]){_java_quote(name)}(?![a-zA-Z0-9])", pseudonym(name))
    return text


def anonymize_by_column(text: Column, name: Column) -> Column:
    """Whole-word replacement of each row's own name."""
    quoted = F.regexp_replace(F.lower(name), r"([^a-z0-9])", r"\\$1")
    pattern = F.concat(F.lit("(?iu)(?<![a-zA-Z0-9])"), quoted, F.lit("(?![a-zA-Z0-9])"))
    return F.regexp_replace(text, pattern, user_hash(name))


class Anonymizer:
    """The same rules for strings in Python, for values nested in JSON."""

    def __init__(self, username: str = "", extra: tuple[str, ...] = (), home: str | None = None) -> None:
        self.rules = [(re.compile(p.replace("(?iu)", "(?i)")), n.replace("$1", r"\g<1>")) for p, n in patterns(username, home)] if username else []
        for name in sorted({x.strip().lower() for x in extra if len(x.strip()) >= SHORT}, key=lambda x: (-len(x), x)):
            self.rules.append((re.compile(rf"(?i)(?<![a-zA-Z0-9]){re.escape(name)}(?![a-zA-Z0-9])"), pseudonym(name)))

    def text(self, text: str) -> str:
        for pattern, new in self.rules:
            text = pattern.sub(new, text)
        return text
