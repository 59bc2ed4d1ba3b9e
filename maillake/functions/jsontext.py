"""JSON text with fixed spacing, for hashing. ``to_json`` writes no blanks, so it cannot be used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import as_col

_SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def quoted(value: Column | str) -> Column:
    """A JSON string literal: control characters escaped in lower-case hex, other text kept."""
    text = as_col(value)
    usual = text
    for char, escape in _SHORT.items():
        usual = F.replace(usual, F.lit(char), F.lit(escape))
    rare = usual
    for code in range(32):
        if chr(code) not in _SHORT:
            rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    body = F.when(text.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rare).otherwise(usual)
    return F.concat(F.lit('"'), body, F.lit('"'))


def quoted_list(values: Column | str) -> Column:
    items = F.array_join(F.transform(as_col(values), quoted), ", ")
    return F.concat(F.lit("["), items, F.lit("]"))
