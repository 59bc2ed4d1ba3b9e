"""Roles and conversation keys of a header table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import conversation, roles

def with_roles(df: DataFrame, agency_domains: Iterable[str]) -> DataFrame:
    """Add sender, customer, agent and first recipient in canonical form, and ``conversation_id``.

    Needs ``from``, ``to``, ``cc`` and ``bcc``. Each address is normalised once per message. The new columns
    come out of ``inline``, so that a later filter on one of them is applied to the value: filters are
    pushed through projections by repeating the whole expression, but not through a generator.
    ``conversation_id`` is null when no pair of addresses can be found.
    """
    everyone = F.concat(F.array("from"), roles.recipients("to", "cc", "bcc"))
    staged = df.withColumn("_people", roles.people(everyone, agency_domains))
    sender = F.get("_people", F.lit(0))
    others = F.slice("_people", F.lit(2), F.size("_people"))
    found = staged.withColumns(
        {
            "_sender": sender["canonical"],
            "_customer": roles.customer_email(sender, others),
            "_agent": roles.agent_email(sender, others),
            "_recipient": roles.first_recipient(others),
        }
    )
    record = F.struct(
        F.col("_sender").alias("from_email_normalized"),
        F.col("_customer").alias("customer_email_normalized"),
        F.col("_agent").alias("agent_email"),
        F.col("_recipient").alias("first_recipient_email"),
        conversation.pair_id("_customer", "_agent", "_sender", "_recipient").alias("conversation_id"),
    )
    return found.select(*df.columns, F.inline(F.array(record)))


def with_participants(df: DataFrame) -> DataFrame:
    return df.withColumn("participants", conversation.participants("from", "to", "cc", "bcc"))


def with_fallback_id(df: DataFrame) -> DataFrame:
    """Add ``fallback_conversation_id`` from day, participants and canonical subject."""
    staged = df if "participants" in df.columns else with_participants(df)
    return staged.withColumn(
        "fallback_conversation_id", conversation.fallback_id("subject_canonical", "participants", "date_utc")
    )


def in_agency(agency_domains: Iterable[str]) -> Column:
    """Whether there is an agency address among sender and recipients."""
    allowed = list(agency_domains)
    everyone = F.concat(F.array("from"), roles.recipients("to", "cc", "bcc"))
    return F.exists(everyone, lambda a: roles.is_agency(a["email"], allowed))


def agency_messages(df: DataFrame, agency_domains: Iterable[str], member: bool = True) -> DataFrame:
    """Messages with (or, with ``member=False``, without) an agency address among sender and recipients."""
    touched = in_agency(agency_domains)
    return df.where(touched if member else ~touched)
