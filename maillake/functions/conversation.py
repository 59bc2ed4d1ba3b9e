"""Conversation keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import as_col, strip
from .dates import day_bucket
from .jsontext import quoted, quoted_list
from .roles import ADDRESS_LIST


def unordered_pair_id(a: Column | str, b: Column | str) -> Column:
    """Hash of two addresses, the same in both directions; null when one is missing."""
    x, y = as_col(a), as_col(b)
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, F.sha2(F.concat(F.lit("pair:"), F.least(x, y), F.lit("|"), F.greatest(x, y)), 256))


def pair_id(customer: Column | str, agent: Column | str, sender: Column | str, recipient: Column | str) -> Column:
    """Customer and agent when both are known, else sender and first recipient, else null."""
    return F.coalesce(unordered_pair_id(customer, agent), unordered_pair_id(sender, recipient))


def participants(sender: Column | str, to: Column | str, cc: Column | str, bcc: Column | str) -> Column:
    """Distinct, sorted, lower-cased addresses of a message (not canonicalised)."""
    empty = F.array().cast(ADDRESS_LIST)
    lists = [F.array(as_col(sender)), *[F.coalesce(as_col(c), empty) for c in (to, cc, bcc)]]
    emails = F.transform(F.concat(*lists), lambda a: F.lower(strip(a["email"])))
    return F.array_sort(F.array_distinct(F.filter(emails, lambda e: F.coalesce(e, F.lit("")) != "")))


def fallback_id(subject_canonical: Column | str, people: Column | str, date_utc: Column | str) -> Column:
    """Hash of day, participants and subject, for corpora without usable addresses or ids."""
    key = F.concat(
        F.lit('fallback:{"date_bucket": '),
        quoted(day_bucket(date_utc)),
        F.lit(', "participants": '),
        quoted_list(people),
        F.lit(', "subject": '),
        quoted(F.lower(as_col(subject_canonical))),
        F.lit("}"),
    )
    return F.sha2(key, 256)
