"""Raw message tables."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mailboxes
from ..operators.mime import header_block

LOG = logging.getLogger("maillake")


def read_raw(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """RAW table: ``mailbox, uid, uid_n, content`` and what else the table holds.

    ``parquet`` is the form for large corpora. ``eml`` reads single files laid out as
    ``<path>/mailbox=<name>/<uid>.eml``; the mailbox is a partition column there, so filters on it
    prune folders.
    """
    if form == "parquet":
        raw = spark.read.parquet(path)
    elif form == "eml":
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml")
        found = files.option("recursiveFileLookup", "false").load(path)
        raw = found.select(
            F.col("mailbox").cast("string").alias("mailbox"),
            F.regexp_extract("path", r"([^/]+)\.eml\z", 1).alias("uid"),
            "content",
        )
    else:
        raise ValueError(f"unknown form {form!r}")
    return raw if "uid_n" in raw.columns else raw.withColumn("uid_n", F.col("uid").try_cast("long"))


def read_headers(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """RAW table whose content is cut to the header block, for ``mime.parse_headers``."""
    return read_raw(spark, path, form).withColumn("content", header_block("content"))


def read_mailboxes(
    spark: SparkSession, path: str, names: list[str], form: str = "parquet", limit: int | None = None
) -> DataFrame:
    """Requested mailboxes in order, each cut to its first ``limit`` messages; missing ones are logged."""
    raw = read_raw(spark, path, form)
    # At most as many rows as names were given.
    for row in mailboxes.missing_mailboxes(raw, names).collect():
        LOG.error("skipping mailbox %r: not found", row["mailbox"])
    chosen = mailboxes.select_mailboxes(raw, names)
    return mailboxes.limit_per_mailbox(chosen, limit, by=("mailbox_ord", "mailbox"))


def union_mailboxes(parts: list[DataFrame]) -> DataFrame:
    """Mailbox tables one after the other, repeated ones included; their position is ``mailbox_ord``."""
    if not parts:
        raise ValueError("no mailbox given")
    whole = parts[0].withColumn("mailbox_ord", F.lit(0))
    for position, part in enumerate(parts[1:], 1):
        whole = whole.unionByName(part.withColumn("mailbox_ord", F.lit(position)))
    return whole


def decode_fetch_prefix(dump: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Server response prefixes to ``uid``, ``flags`` and ``provider_thread_id``; rows without uid are dropped."""
    text = F.col(prefix)
    flags = F.split(F.regexp_extract(text, r"FLAGS\s+\(([^)]*)\)", 1), r"(?U)[\s\x1c-\x1f]+")
    thread = F.regexp_extract(text, r"X-GM-THRID\s+(\d+)", 1)
    return (
        dump.withColumn("uid", F.regexp_extract(text, r"UID\s+(\d+)", 1))
        .where(F.col("uid") != "")
        .withColumn("flags", F.filter(flags, lambda f: f != ""))
        .withColumn("provider_thread_id", F.when(thread != "", thread))
    )
