"""Filters that users type, compiled to column expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed_lower(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def match_filter(filter_text: str, text: Column) -> Column:
    """``|`` or, ``&`` and, ``!`` not; terms are parts of the text in any case. An empty
    filter, and an empty term, match everything."""
    value = filter_text.strip().lower()
    if not value:
        return F.lit(True)
    low = trimmed_lower(text)

    def term(part: str) -> Column:
        part = part.strip()
        return ~low.contains(part[1:].strip()) if part.startswith("!") else low.contains(part)

    return reduce(or_, (reduce(and_, map(term, part.split("&"))) for part in value.split("|")))


def search_all(line: Column, terms: list[str]) -> Column:
    """Whether the line has every term, letter by letter. At least one term is needed."""
    if not terms:
        raise ValueError("a search needs a term")
    return reduce(and_, (line.contains(t) for t in terms))


def valid_name(name: Column) -> Column:
    """Names of accounts and buckets: 1 to 64 letters, digits, dashes and underscores."""
    return name.rlike(r"^[A-Za-z0-9_-]{1,64}\z")


def valid_source_name(name: Column) -> Column:
    """Names of sources: dots too, but not dots alone."""
    return name.rlike(r"^[A-Za-z0-9_.-]{1,64}\z") & ~name.rlike(r"^\.+\z")


def valid_path(path: Column) -> Column:
    """Paths of 1 to 1000 bytes without empty, . or .. parts, backslashes and NULs."""
    parts = F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))
    return F.octet_length(path).between(1, 1000) & ~parts & ~path.contains("\\") & ~path.contains("\0")
