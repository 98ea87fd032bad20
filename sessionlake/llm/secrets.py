"""Operator 8: secret scans: fixed patterns, and sliding-window Shannon entropy of candidate strings.

A candidate is a maximal run of at least ``shortest`` characters of the secret alphabet. A window of ``width``
characters slides over it; counts per character, kept for each class of characters, change by one character in and one
out, so a step costs a constant. A window counts where the entropy of a class's characters in it reaches that class's
threshold and the class fills most of the window. Neighbouring windows that count merge into one span. Allow-listed
candidates (all letters of one case, digests named as such and no longer than one, UUIDs, ascending characters, words
joined by separators) give none; a placeholder (``example``, ``xxxx``) hides the windows that touch it and no others, so
that chance can't hide a long secret. Repeated characters are for the windows' entropy to tell. What one of the fixed
patterns covers is left to it.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, text_rows

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = (b"passw", b"secret", b"token", b"api")
_HEX_RUN = bytes(104 if 48 <= c <= 57 or 97 <= c <= 102 else 32 for c in range(256))
_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SECRET_RUN = bytes(120 if c in _ALPHABET else 32 for c in range(256))
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test[_-]?key|lorem")
_LONGEST_DIGEST = 128
_DIGEST = re.compile(r"(?i)(?:sha-?(?:1|256|384|512)|md5|integrity|checksum|commit|digest)[\"']?\s*[:=-]\s*[\"']?$")


@dataclass(frozen=True)
class Entropy:
    """``width``: characters of a window; ``shortest``: of a candidate; ``share``: of a window that a class must fill;
    thresholds in bits per character for hexadecimal, alphanumeric and all characters of the alphabet."""

    width: int = 20
    shortest: int = 20
    share: float = 0.9
    hexadecimal: float = 3.0
    alphanumeric: float = 3.7
    mixed: float = 3.9


def _classes(rule: Entropy) -> list[tuple[frozenset[str], float]]:
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return [(frozenset(digits + "abcdefABCDEF"), rule.hexadecimal), (frozenset(digits + lower + upper), rule.alphanumeric), (frozenset(digits + lower + upper + "+/_=-"), rule.mixed)]


def allowed(candidate: str, before: str = "") -> bool:
    """Whether a candidate is no secret for a reason other than its entropy. ``before``: the text just before it."""
    letters = [c for c in candidate if c.isalpha()]
    digits = sum(c.isdigit() for c in candidate)
    if not digits and (candidate.islower() or candidate.isupper() or len({c.islower() for c in letters}) < 2):
        return True
    if not letters:
        return True
    if _UUID.fullmatch(candidate) or len(candidate) <= _LONGEST_DIGEST and _DIGEST.search(before):
        return True
    parts = [p for p in re.split(r"[-_/+=]", candidate) if p]
    if len(parts) > 1 and all(p.isalpha() and (p.islower() or p.isupper() or p.istitle()) or p.isdigit() and len(p) <= 4 for p in parts):
        return True
    steps = sum(ord(b) - ord(a) == 1 for a, b in zip(candidate, candidate[1:]))
    return steps * 2 > len(candidate)


def window_spans(candidate: str, rule: Entropy = Entropy()) -> list[tuple[int, int]]:
    """The merged windows of a candidate that reach a class's threshold. Linear in its length."""
    n, width = len(candidate), rule.width
    if n < width:
        return []
    # -(c / m) log2(c / m) summed over characters is log2(m) - sum(c log2 c) / m: one sum a class is all that's kept.
    part = [0.0] + [c * math.log2(c) for c in range(1, width + 2)]  # one comes in before one goes out
    kinds = _classes(rule)
    member = {c: tuple(k for k, (chars, _) in enumerate(kinds) if c in chars) for c in set(candidate)}
    counts: dict[str, int] = {}
    size, total, spans = [0] * len(kinds), [0.0] * len(kinds), []
    for i, c in enumerate(candidate):
        old = counts.get(c, 0)
        counts[c] = old + 1
        for k in member[c]:
            size[k] += 1
            total[k] += part[old + 1] - part[old]
        if i >= width:
            c = candidate[i - width]
            old = counts[c]
            counts[c] = old - 1
            for k in member[c]:
                size[k] -= 1
                total[k] += part[old - 1] - part[old]
        if i >= width - 1 and any(m >= rule.share * width and math.log2(m) - total[k] / m >= kinds[k][1] - 1e-9 for k, m in enumerate(size)):
            a, b = i - width + 1, i + 1
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
    return spans


def secret_spans(candidate: str, rule: Entropy = Entropy()) -> list[tuple[int, int]]:
    """The merged windows that count and touch no placeholder: those of the stretches between placeholders."""
    cuts = [(m.start(), m.end()) for m in _PLACEHOLDER.finditer(candidate)]
    spans: list[tuple[int, int]] = []
    for start, end in zip([0, *[b for _, b in cuts]], [*[a for a, _ in cuts], len(candidate)]):
        spans += [(a + start, b + start) for a, b in window_spans(candidate[start:end], rule)]
    return spans


def beside(candidate: str, a: int, b: int, taken: list[tuple[int, int]], rule: Entropy = Entropy()) -> list[tuple[int, int]]:
    """What of a merged span no taken span covers: the span itself if none touches it, else the windows that count in
    the pieces left between."""
    over = sorted((x, y) for x, y in taken if a < y and x < b)
    if not over:
        return [(a, b)]
    out, at = [], a
    for x, y in [*over, (b, b)]:
        out += [(at + u, at + v) for u, v in secret_spans(candidate[at : max(at, x)], rule)]
        at = max(at, y)
    return out


def scan(text: str | None, rule: Entropy = Entropy()) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed. Null and empty texts have none."""
    if not text:
        return []
    raw = text.encode()
    low = raw.translate(_LOWER)
    found: list[tuple[str, int, int]] = []
    if any(w in low for w in _WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"h" * 16 in raw.translate(_HEX_RUN):
        found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 16]
    runs = raw.translate(_SECRET_RUN)
    at, base = runs.find(b"x" * rule.shortest), sorted((x, y) for _, x, y in found)
    reach = list(itertools.accumulate((y for _, y in base), max))
    past, start, first = 0, 0, 0  # bytes read so far, their code points, base spans that end before the candidate
    while at >= 0:
        end = runs.find(b" ", at)
        end = len(runs) if end < 0 else end
        candidate = raw[at:end].decode()
        start, past = start + len(raw[past:at].decode()), at
        while first < len(base) and reach[first] <= start:
            first += 1
        if not allowed(candidate, text[max(0, start - 24) : start]):
            taken = [(x - start, y - start) for x, y in itertools.takewhile(lambda s: s[0] < start + len(candidate), base[first:])]
            for a, b in secret_spans(candidate, rule):
                found += [("entropy", start + x, start + y) for x, y in beside(candidate, a, b, taken, rule)]
        at = runs.find(b"x" * rule.shortest, end)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def secrets(docs: DataFrame, rule: Entropy = Entropy()) -> DataFrame:
    """doc_id, spans (kind, start, end): a row for each row of ``docs``, an empty list where nothing is found."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames):
            yield pd.DataFrame({"doc_id": frame["doc_id"], "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t, rule)] for t in frame["text"]]})

    return text_rows(docs).mapInPandas(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query from those of :func:`secrets`."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each span, overlapping ones together, replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
