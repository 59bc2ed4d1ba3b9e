"""Roll-ups over the derived ids. All aggregates combine before the shuffle, so hot ids stay small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _span(sent: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("messages"),
        F.min(sent).alias("first_sent"),
        F.max(sent).alias("last_sent"),
    ]


def conversations(messages: DataFrame, sent: str = "date_ts", order: tuple[str, ...] = ("mailbox_ord", "uid_n")) -> DataFrame:
    """Messages, span, customers and last subject of each conversation."""
    return (
        messages.where(F.col("conversation_id").isNotNull())
        .groupBy("conversation_id")
        .agg(
            *_span(sent),
            F.countDistinct("customer_email_normalized").alias("customers"),
            F.max_by("subject_canonical", F.struct(sent, *order)).alias("last_subject"),
        )
    )


def sessions(messages: DataFrame, sent: str = "date_ts") -> DataFrame:
    """Messages, span, conversations and agents of each customer session."""
    return (
        messages.where(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(
            *_span(sent),
            F.countDistinct("conversation_id").alias("conversations"),
            F.countDistinct("agent_email").alias("agents"),
        )
    )


def customers(messages: DataFrame, sent: str = "date_ts") -> DataFrame:
    """Messages, span, addresses and conversations of each customer."""
    return (
        messages.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            *_span(sent),
            F.countDistinct("customer_email_normalized").alias("addresses"),
            F.countDistinct("conversation_id").alias("conversations"),
        )
    )


def conversation_participants(messages: DataFrame) -> DataFrame:
    """Who takes part in each conversation, one row per participant.

    Rows, not a list: a mailing-list conversation can have more participants than one row should hold.
    Needs ``participants`` from ``people.with_participants``.
    """
    return (
        messages.where(F.col("conversation_id").isNotNull())
        .select("conversation_id", F.explode("participants").alias("participant"))
        .groupBy("conversation_id", "participant")
        .agg(F.count(F.lit(1)).alias("messages"))
    )


def messages_per_mailbox(messages: DataFrame) -> DataFrame:
    """Written messages of each mailbox."""
    return messages.groupBy("mailbox").agg(F.count(F.lit(1)).alias("messages"))
