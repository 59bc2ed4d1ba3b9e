"""Message-id headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import as_col, strip


def extract_ids(value: Column | str) -> Column:
    """All ``<...>`` ids of a header, lower-cased, without brackets; empty array for null."""
    tokens = F.regexp_extract_all(as_col(value), F.lit(r"<([^>]+)>"), F.lit(1))
    clean = F.filter(F.transform(tokens, lambda t: F.lower(strip(t))), lambda t: t != "")
    return F.coalesce(clean, F.array().cast("array<string>"))


def first_id(value: Column | str) -> Column:
    return F.get(extract_ids(value), F.lit(0))


def canonical_id(value: Column | str) -> Column:
    """Trimmed, lower-cased, without one leading ``<`` and one trailing ``>``; null when blank."""
    bare = F.regexp_replace(F.lower(strip(value)), r"\A<|>\z", "")
    return F.get(F.regexp_extract_all(bare, F.lit(r"(?s)\A.+\z"), F.lit(0)), F.lit(0))


def header_id(value: Column | str) -> Column:
    """First id of a header in canonical form: message_id and in_reply_to."""
    return canonical_id(first_id(value))


def header_ids(value: Column | str) -> Column:
    """All ids of a header in canonical form: references."""
    return F.filter(F.transform(extract_ids(value), canonical_id), lambda i: i.isNotNull())
