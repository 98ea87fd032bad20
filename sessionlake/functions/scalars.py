"""Scalar functions as column expressions: each stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_strip(c: Column) -> Column:
    """Trim all Unicode white space, which ``trim`` does not."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(py_strip(c) != "", c)


def model_key(model: Column) -> Column:
    """The key of a model in breakdowns: after the last slash, ``_`` and ``.`` as ``-``; null where blank."""
    key = F.translate(F.substring_index(F.trim(model), "/", -1), "_.", "--")
    return F.when(key != "", key)


def project_key(project: Column) -> Column:
    """The key of a project in breakdowns: after the first colon, lower case, ``_`` and ``.`` as ``-``."""
    key = F.translate(F.lower(F.regexp_replace(F.trim(project), r"^[^:]*:", "")), "_.", "--")
    return F.when(key != "", key)


def format_tokens(n: Column) -> Column:
    """Billions and millions with one decimal, thousands with none; halves go to the even digit."""
    return (
        F.when(n >= 1_000_000_000, F.format_string("%.1fB", F.bround(n / 1e9, 1)))
        .when(n >= 1_000_000, F.format_string("%.1fM", F.bround(n / 1e6, 1)))
        .when(n >= 1_000, F.format_string("%.0fK", F.bround(n / 1e3, 0)))
        .otherwise(n.cast("string"))
    )


def format_size(n: Column) -> Column:
    k = 1024.0
    return (
        F.when(n < k, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(n < k**2, F.format_string("%.1f KB", F.bround(n / k, 1)))
        .when(n < k**3, F.format_string("%.1f MB", F.bround(n / k**2, 1)))
        .otherwise(F.format_string("%.1f GB", F.bround(n / k**3, 1)))
    )


def format_seconds(s: Column) -> Column:
    return F.format_string("%.2fs", s)


def excerpt(text: Column, most: int = 220) -> Column:
    t = py_strip(text)
    return F.when(F.length(t) > most, F.concat(py_strip(F.substring(t, 1, most)), F.lit("..."))).otherwise(t)


def normalized_text(text: Column) -> Column:
    """White space collapsed to single spaces."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def largest_number(text: Column) -> Column:
    """The largest integer written in a text, null without one."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long")))


def csv_list(text: Column) -> Column:
    """Comma-separated items, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def project_of_path(cwd: Column, source: str) -> Column:
    """``source:last part of the path``, ``source:unknown`` without one."""
    last = F.element_at(F.filter(F.split(cwd, r"[/\\]"), lambda x: x != ""), -1)
    return F.concat(F.lit(f"{source}:"), F.coalesce(last, F.lit("unknown")))


def project_of_encoded_dir(name: Column) -> Column:
    """The project within a path whose separators became hyphens: what follows ``Users`` or ``home``, the user and a
    common folder."""
    parts = F.filter(F.split(name, "-"), lambda x: x != "")
    users, home = F.array_position(parts, "Users"), F.array_position(parts, "home")
    at = F.when(users > 0, users).when(home > 0, home).otherwise(F.lit(-1))
    after = F.when(at > 0, F.slice(parts, (at + 2).cast("int"), F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)
    common = F.array(*[F.lit(x) for x in ("Documents", "Downloads", "Desktop")])
    rest = F.when(F.array_contains(common, F.try_element_at(after, F.lit(1))), F.slice(after, 2, F.greatest(F.size(after), F.lit(1)))).otherwise(after)
    joined = F.array_join(rest, "-")
    return F.when(joined != "", joined).otherwise(F.when(at > 0, F.lit("~home")).otherwise(name))


def timestamp_text(millis: Column) -> Column:
    """Epoch milliseconds as ISO text in UTC; the fraction only where there is one."""
    t = F.timestamp_millis(millis.cast("long"))
    return F.when(F.pmod(millis, F.lit(1000)) == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def seconds_or_millis(x: Column) -> Column:
    """Numbers above ten billion are milliseconds, others seconds: epoch seconds."""
    return F.when(F.abs(x) > 1e10, x / 1000).otherwise(x)


def user_hash(name: Column) -> Column:
    """The pseudonym of a user name, hashed as it is given."""
    return F.concat(F.lit("user_"), F.substring(F.sha2(name, 256), 1, 8))


def masked(secret: Column) -> Column:
    """First and last four characters; three stars for eight or fewer."""
    return F.when(F.length(secret) <= 8, F.lit("***")).otherwise(F.concat(F.substring(secret, 1, 4), F.lit("..."), F.substring(secret, -4, 4)))


def finding_fingerprint(entity: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", entity, text), 256)


def set_fingerprint(strings: Column) -> Column:
    """SHA-256 of a set of strings, whatever their order: each ends with a zero character."""
    ended = F.transform(F.array_sort(F.array_distinct(strings)), lambda x: F.concat(x, F.lit("\x00")))
    return F.sha2(F.array_join(ended, ""), 256)


def json_pointer(base: Column, part: Column) -> Column:
    return F.concat(base, F.lit("/"), F.replace(F.replace(part, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def clean_text(text: Column) -> Column:
    """Without terminal escapes, tabs as four spaces, lines without trailing blanks."""
    plain = F.regexp_replace(text, "\x1b\\[[0-9;?]*[ -/]*[@-~]", "")
    return F.regexp_replace(F.replace(plain, F.lit("\t"), F.lit("    ")), r"(?m)[ \x0b\f\r]+$", "")


def escaped_emojis(text: Column) -> Column:
    """Characters beyond U+FFFF, which some YAML writers can't print, as ``__EMOJI_<hex>__``; texts without any as they
    are."""
    mark = lambda c: F.when(c.rlike(r"^[\x{10000}-\x{10FFFF}]$"), F.concat(F.lit("__EMOJI_"), F.lower(F.hex(F.ascii(c))), F.lit("__"))).otherwise(c)
    return F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), F.array_join(F.transform(F.split(text, ""), mark), "")).otherwise(text)


def restored_emojis(text: Column) -> Column:
    """The inverse of :func:`escaped_emojis`, also for marks of letters in either case."""
    pieces = F.split(text, "(?=__EMOJI_[0-9a-fA-F]{5,6}__)")
    code = lambda p: F.conv(F.regexp_extract(p, "^__EMOJI_([0-9a-fA-F]{5,6})__", 1), 16, 10).cast("int")
    # UTF-8 of a character beyond U+FFFF, byte by byte.
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    six = lambda p, n: F.call_function("shiftright", code(p), F.lit(n)).bitwiseAND(63).bitwiseOR(128)
    char = lambda p: F.decode(F.unhex(F.concat(byte(F.call_function("shiftright", code(p), F.lit(18)).bitwiseOR(240)), byte(six(p, 12)), byte(six(p, 6)), byte(six(p, 0)))), "UTF-8")
    back = lambda p: F.when(p.rlike("^__EMOJI_[0-9a-fA-F]{5,6}__"), F.concat(char(p), F.regexp_replace(p, "^__EMOJI_[0-9a-fA-F]{5,6}__", ""))).otherwise(p)
    return F.when(text.contains("__EMOJI_"), F.array_join(F.transform(pieces, back), "")).otherwise(text)


def shannon_entropy(text: Column) -> Column:
    """Bits per character, of the characters' frequencies."""
    n = F.length(text).cast("double")
    p = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), F.lit(0.0), lambda e, c: e - p(c) * F.log2(p(c)))


def mixed_types(text: Column) -> Column:
    """At least two of lower-case letters, upper-case letters and digits."""
    has = lambda pattern: text.rlike(pattern).cast("int")
    return has("[a-z]") + has("[A-Z]") + has("[0-9]") >= 2


def without_accents(text: Column) -> Column:
    """Letters of Latin script without their accents, by a table of the composed letters of Latin-1 and Latin
    Extended-A; combining marks go too."""
    import unicodedata

    pairs = [(chr(i), d[0]) for i in range(0xC0, 0x180) if len(d := unicodedata.normalize("NFD", chr(i))) > 1]
    plain = F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return F.regexp_replace(plain, r"\p{Mn}+", "")
