"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A place where no letter, digit or underscore of any script is on the left or right.
LEFT, RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Patterns of redaction, what is kept in front, what is replaced.
REDACTIONS = (
    (r"(?i)(Bearer\s+)[A-Za-z0-9._~+/=-]+", "$1[REDACTED]"),
    (r"(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*)[^\s,;]+", "$1[REDACTED]"),
    (r"\b(sk-[A-Za-z0-9_-]{8,}|sk-or-v1-[A-Za-z0-9_-]{8,})\b", "[REDACTED]"),
)


def stripped(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def sentences(c: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` and white space; empty pieces go."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def token_estimate(c: Column) -> Column:
    """1.3 times the number of white-space words, cut to a whole number, at least 1."""
    words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), (words * F.lit(1.3)).cast("int"))


def redacted(c: Column) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, *rule), REDACTIONS, c)


def ascii_safe(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "?")


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, (c.contains(w) for w in words))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def chunk_id(entity: Column, section: Column, index: Column, body: Column) -> Column:
    """``entity__section__c{index}__`` and ten digits of the body's hash."""
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit(" > "), F.lit("__")), F.lit(" "), F.lit("_")), F.lit("/"), F.lit("_"))
    return F.concat(plain(entity), F.lit("__"), plain(section), F.lit("__c"), index.cast("string"), F.lit("__"), F.left(content_hash(body), F.lit(10)))


def multivalue(c: Column) -> Column:
    """Values of a field: one a line, bullets taken off, lines without parentheses split at commas."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^[•\-*\s]+|[•\-*\s]+$", ""))
    split = F.transform(lines, lambda x: F.when(x.contains("(") & x.contains(")"), F.array(x)).otherwise(F.split(x, ",")))
    return F.filter(F.transform(F.flatten(split), stripped), lambda x: x != "")
