"""Writers of the exported table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas


def write_ndjson(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """One JSON object per line, nulls written out, text unescaped. A single file is opt-in: one task writes it."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EXPORT).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", arrange: bool = True) -> None:
    """A folder per mailbox. Rows are arranged by mailbox first, large mailboxes over several tasks.

    Without that every task writes a small file for every mailbox it meets; ``arrange=False`` keeps a given order.
    """
    out = df.hint("rebalance", "mailbox") if arrange else df
    out.write.mode(mode).partitionBy("mailbox").parquet(path)
