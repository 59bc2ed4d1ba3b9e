"""The mailbox profile: counts per mailbox, total and preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mailboxes
from ..sources import messages


def mailbox_profile(
    spark: SparkSession,
    path: str,
    names: list[str] | None = None,
    form: str = "parquet",
    readable: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Counts per mailbox and the summary row. Without ``names`` every mailbox of the table is profiled.

    A landed table has no rows of an empty mailbox: ``readable`` names the mailboxes that could be opened, so
    that empty ones count 0 and the others -1. Mailboxes with messages can always be opened.
    """
    raw = messages.read_raw(spark, path, form)
    if names is None:
        wanted = mailboxes.list_mailboxes(raw).withColumn("mailbox_ord", F.lit(0))
    else:
        wanted = mailboxes.requested(spark, names)
        raw = raw.where(F.col("mailbox").isin(sorted(set(names))))
    known = None
    if readable is not None:
        known = mailboxes.list_mailboxes(raw).union(spark.createDataFrame([(m,) for m in readable], "mailbox string"))
    return mailboxes.profile(raw, wanted, known), mailboxes.preview(wanted)
