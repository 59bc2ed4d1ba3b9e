"""Subject canonicalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import as_col, collapse, strip

# Reply and forward prefixes.
PREFIXES = (
    "re", "fwd", "fw", "aw", "wg", "sv", "rv", "res", "enc", "vb", "tr",
    "ré", "antw", "antwort", "回复", "轉寄", "转发", "пере", "ответ", "轉發",
)


def canonical_subject(value: Column | str) -> Column:
    """Subject without stacked prefixes; null gives an empty text.

    Encoded words must already be decoded (see ``words.decode_words``). ``\\G`` continues where the
    last prefix ended, so a subject with thousands of prefixes needs no recursion in the regex engine.
    """
    prefix = "|".join(PREFIXES)
    flat = collapse(F.coalesce(as_col(value), F.lit("")))
    return strip(F.regexp_replace(flat, rf"(?iu)\G(?:{prefix}) *(?:\[\p{{Nd}}+\])? *: *", ""))
