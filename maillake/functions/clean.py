"""White-space and truth-value rules shared by the other builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points str.strip() and \s treat as white space (wider than Spark's trim).
SPACE_POINTS = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
SPACE_CHARS = "".join(map(chr, SPACE_POINTS))
# The same set as the inside of a Java character class.
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# The texts that count as true.
TRUE_WORDS = ("1", "true", "yes", "y", "t", "on")
# The mailbox profile job has its own, shorter list.
PROFILE_TRUE_WORDS = ("1", "true", "yes", "y", "on")


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Trim Unicode white space and the ASCII separators on both sides."""
    return F.btrim(as_col(value), F.lit(SPACE_CHARS))


def collapse(value: Column | str) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return strip(F.regexp_replace(as_col(value), f"[{SPACE}]+", " "))


def is_blank(value: Column | str) -> Column:
    return F.coalesce(strip(value), F.lit("")) == ""


def to_bool(value: Column | str, default: bool, words: tuple[str, ...] = TRUE_WORDS) -> Column:
    """Text to boolean; null takes the default, unknown text is false."""
    return F.coalesce(F.lower(strip(value)).isin(*words), F.lit(default))
