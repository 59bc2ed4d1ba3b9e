"""Joins of messages with the CRM map and with separately parsed headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.roles import session_id
from . import skew
from .lineage import Scratch

HEADER_COLUMNS = (
    "message_id", "in_reply_to", "references", "subject", "subject_canonical", "from", "to", "cc", "bcc",
    "date_header", "date_utc",
)


def with_customer_id(
    df: DataFrame,
    crm: DataFrame,
    tenant: str = "default",
    keys: tuple[str, ...] = ("mailbox", "uid"),
    broadcast_bytes: int = skew.BROADCAST_BYTES,
) -> DataFrame:
    """Add ``customer_id`` (CRM value, else the address itself) and the tenant-scoped ``session_id``.

    ``crm`` has ``email`` and ``customer_id``; its addresses are matched as they are. An empty CRM value
    is kept as customer id and gives no session.
    """
    unique = crm.groupBy("email").agg(F.max("customer_id").alias("_crm_id"))
    email = "customer_email_normalized"
    if skew.measured_bytes(unique) > broadcast_bytes:
        # Only the addresses of these messages are wanted: one narrow pass counts them, and no body is shuffled for
        # the rest of a large map. Both are stored, as each further look at the messages would compute them anew.
        tables = Scratch(df.sparkSession, "customer-id")
        asked = df.where(F.col(email).isNotNull()).groupBy(F.col(email).alias("email")).agg(F.count(F.lit(1)).alias("n"))
        asked = tables.write(asked, "asked")
        unique = tables.write(unique.join(asked.select("email"), "email", "left_semi"), "map")
        if skew.measured_bytes(unique) > broadcast_bytes:
            joined = skew.lookup(df, unique, email, "email", list(keys), skew.heavy_counts(asked, "email", "n"))
        else:
            joined = skew.lookup_measured(df, unique, email, "email", list(keys), broadcast_bytes)
    else:
        joined = skew.lookup_measured(df, unique, email, "email", list(keys), broadcast_bytes)
    found = joined.withColumn("customer_id", F.coalesce("_crm_id", "customer_email_normalized")).drop("_crm_id")
    return found.withColumn("session_id", session_id("customer_id", tenant))


def last_of_each(df: DataFrame, keys: tuple[str, ...], record: Column, name: str) -> DataFrame:
    """One record per key: that of the last mailbox position, and there always the same one."""
    place = F.col("mailbox_ord") if "mailbox_ord" in df.columns and "mailbox_ord" not in keys else F.lit(0)
    return df.groupBy(*keys).agg(F.max_by(record, F.struct(F.coalesce(place, F.lit(-1)), F.xxhash64(record))).alias(name))


def with_headers(full: DataFrame, headers: DataFrame, keys: tuple[str, ...] = ("mailbox", "uid")) -> DataFrame:
    """Full messages with the separately parsed headers where there are any, else their own.

    Header rows without a full message are dropped. The header record wins as a whole, even where one of
    its values is null; of several records of a key the last one counts, so no message is repeated.
    """
    single = last_of_each(headers, keys, F.struct(*HEADER_COLUMNS), "_headers")
    joined = full.join(single, list(keys), "left")
    kept = {c: F.when(F.col("_headers").isNotNull(), F.col(f"_headers.{c}")).otherwise(F.col(c)) for c in HEADER_COLUMNS}
    return joined.withColumns(kept).drop("_headers")


def with_known_conversation(full: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("mailbox", "uid")) -> DataFrame:
    """Conversation id computed earlier where there is one (the last one), else the one computed from the full message."""
    earlier = last_of_each(known, keys, F.struct("conversation_id"), "_last")
    earlier = earlier.select(*keys, F.col("_last.conversation_id").alias("_known"))
    joined = full.join(earlier, list(keys), "left")
    usable = F.when(F.col("_known") != "", F.col("_known"))
    return joined.withColumn("conversation_id", F.coalesce(usable, "conversation_id")).drop("_known")


def with_header_index(full: DataFrame, index: DataFrame, keys: tuple[str, ...] = ("mailbox", "uid")) -> DataFrame:
    """``with_headers`` and the look-up of a conversation id (``_known``, null where there is none) in one join.

    ``index`` has the header records of an earlier pass and their ``conversation_id``.
    """
    single = last_of_each(index, keys, F.struct(*HEADER_COLUMNS, "conversation_id"), "_headers")
    joined = full.join(single, list(keys), "left")
    kept = {c: F.when(F.col("_headers").isNotNull(), F.col(f"_headers.{c}")).otherwise(F.col(c)) for c in HEADER_COLUMNS}
    usable = F.when(F.col("_headers.conversation_id") != "", F.col("_headers.conversation_id"))
    return joined.withColumns({**kept, "_known": usable}).drop("_headers")
