"""Scans as table functions, for SQL: ``select t.* from docs, lateral high_entropy(text) t``.

Large tables are better scanned by :mod:`sessionlake.operators.scans`, which stays in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import redact, scans


class PiiMatches:
    def eval(self, text: str) -> Iterator[tuple[str, str, int]]:
        for kind, pattern in scans.PII_PATTERNS.items():
            for m in re.finditer(pattern, text or ""):
                if kind == "emails" and any(x in m[0] for x in scans.EMAIL_NOISE) or m[0] in scans.KEY_NOISE:
                    continue
                yield kind, m[0], m.start()


class HighEntropy:
    def eval(self, text: str) -> Iterator[tuple[str, float]]:
        for token in dict.fromkeys(re.findall(scans.CANDIDATE, text or "")):
            e = redact.entropy(token)
            if e >= 4.0 and harmless(token) is False:
                yield token, round(e, 2)


def harmless(token: str) -> bool:
    """The rules of :func:`scans.suspicious` on a Python string."""
    low = token.lower()
    return (
        len(token) > 512
        or token.startswith(scans.KNOWN_PREFIXES)
        or low.startswith(scans.BENIGN_PREFIXES)
        or bool(re.fullmatch("[0-9a-fA-F]+", token) or re.match(scans.UUID, token))
        or any(x in low for x in (*scans.FILE_EXTENSIONS, *scans.BENIGN_PARTS))
        or token.count("/") >= 2
        or token.count(".") >= 3
        or not redact.mixed(token)
    )


def register(spark: SparkSession) -> None:
    spark.udtf.register("pii_matches", udtf(PiiMatches, returnType="kind string, match string, pos int"))
    spark.udtf.register("high_entropy", udtf(HighEntropy, returnType="match string, entropy double"))
