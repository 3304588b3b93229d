"""Column helpers that the URL, extraction and rewriting functions share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """Lower case of ASCII letters only: URLs and MIME types are compared by bytes."""
    return F.translate(col(c), UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: long expressions would otherwise be copied at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(c: Column, needles: list[str] | tuple[str, ...]) -> Column:
    """Whether any needle is found; what is searched is worked out once."""
    return let(c, lambda x: reduce(lambda a, b: a | b, (F.contains(x, F.lit(n)) for n in needles)))


def contains_icase(c: Column | str, needle: str) -> Column:
    return F.contains(ascii_lower(c), F.lit(needle.lower()))


def trim_space(c: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.regexp_replace(c, r"^[ \t\n\r\x0b\f]+|[ \t\n\r\x0b\f]+$", "")


def group(c: Column, pattern: str, n: int = 1) -> Column:
    return F.regexp_extract(c, pattern, n)


def groups(c: Column, pattern: str, n: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(n))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)
