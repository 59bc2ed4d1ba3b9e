"""Keeping bad messages out of the tables without stopping the job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_bad_rows(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the quarantine table of those that failed. Both read ``parsed``: write it first."""
    good = parsed.where(F.col("error").isNull()).drop("stage", "error")
    bad = parsed.where(F.col("error").isNotNull()).select("mailbox", "uid", "stage", "error")
    return good, bad


def quarantine_counts(parsed: DataFrame) -> DataFrame:
    """Messages per outcome: ``ok`` or the stage that failed."""
    return parsed.groupBy(F.coalesce("stage", F.lit("ok")).alias("stage")).agg(F.count(F.lit(1)).alias("messages"))
