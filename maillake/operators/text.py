"""HTML-to-text job over a page or body table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html


def html_to_text(df: DataFrame, column: str, out: str = "text", mode: str = "nodes") -> DataFrame:
    """Add ``out``: text nodes on lines (``nodes``) or one line (``flat``).

    Both have an Arrow stage; in the flat one it only sees texts with unusual entities or unclosed scripts.
    """
    if mode == "nodes":
        return df.withColumn(out, html.nodes(column))
    if mode != "flat":
        raise ValueError(f"unknown mode {mode!r}")
    return flat_text(df, column, out)


def flat_text(df: DataFrame, column: str, out: str) -> DataFrame:
    """The ``flat`` mode. Each step uses the one before several times, so each is a column of its own."""
    stripped = df.withColumn(out, html.without_scripts(column))
    return stripped.withColumn(out, html.without_tags(out)).withColumn(out, html.decoded(out))
