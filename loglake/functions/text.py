"""Text predicates and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyword_match(message: Column, keyword: Column, mode: str = "contains") -> Column:
    """Message predicate of an alert rule.

    ``contains``: literal substring (default). ``like``: the keyword goes into
    ``'%' || keyword || '%'`` with ``%`` and ``_`` as wildcards and a
    backslash as a plain character, i.e. SQL LIKE without an escape char.
    """
    if mode == "contains":
        return F.contains(message, keyword)
    if mode == "like":
        escaped = F.replace(keyword, F.lit("\\"), F.lit("\\\\"))
        return F.like(message, F.concat(F.lit("%"), escaped, F.lit("%")), F.lit("\\"))
    raise ValueError(f"unknown keyword mode {mode!r}")


def grams(text: Column, width: int) -> Column:
    """The distinct pieces of ``width`` characters of a text; none if it is shorter."""
    chars = F.split(text, "")
    at = F.sequence(F.lit(0), F.size(chars) - width)
    pieces = F.transform(at, lambda i: F.concat(*[chars[i + k] for k in range(width)]))
    return F.array_distinct(F.when(F.size(chars) >= width, pieces).otherwise(F.array().cast("array<string>")))


def needed_grams(keyword: Column, mode: str, width: int) -> Column:
    """Pieces that every message matching the keyword contains: those of ``width``
    characters of its literal stretches, or else the shorter stretches whole."""
    parts = F.filter(F.split(keyword, "[%_]") if mode == "like" else F.array(keyword), lambda p: p != "")
    long = F.flatten(F.transform(parts, lambda p: grams(p, width)))
    return F.when(F.size(long) > 0, long).otherwise(F.array_distinct(F.filter(parts, lambda p: F.length(p) < width)))


def filter_name(log_group: Column, domain: Column, prefix: str = "loglake-") -> Column:
    """Subscription-filter name: trim slashes at both ends, inner '/' -> '-',
    then ``{prefix}{domain}-{group}``."""
    trimmed = F.regexp_replace(log_group, r"^/+|/+$", "")
    return F.concat(F.lit(prefix), domain, F.lit("-"), F.regexp_replace(trimmed, "/", "-"))
