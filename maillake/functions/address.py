"""E-mail address normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import as_col, strip

# The two domains whose local part ignores dots and plus tags, and the validity rule.
DOTLESS_DOMAINS = ("gmail.com", "googlemail.com")
VALID = r"\A[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\z"


def lowered(value: Column | str) -> Column:
    return F.coalesce(F.lower(strip(value)), F.lit(""))


def address_facts(addresses: Column | str) -> Column:
    """Texts, already ``lowered`` -> array<struct<raw, domain, canonical>>, same order.

    Lambdas share no common subexpressions, so each step is a ``transform`` of its own: what is used
    more than once is a field of the step before. ``domain`` is the text after the first ``@`` (not
    validated, empty without one) and ``canonical`` the normalised address, null when it is not valid.
    Unicode NFC is left out: the validity rule is ASCII-only and NFC maps nothing into its characters.
    """
    at = F.transform(as_col(addresses), lambda x: F.struct(x.alias("raw"), F.instr(x, "@").alias("at")))
    halves = F.transform(
        at,
        lambda x: F.struct(
            x["raw"].alias("raw"),
            strip(F.left(x["raw"], x["at"] - 1)).alias("local"),
            F.when(x["at"] > 0, strip(F.substr(x["raw"], x["at"] + 1))).otherwise(F.lit("")).alias("domain"),
        ),
    )
    bare = F.transform(
        halves,
        lambda x: F.struct(
            x["raw"].alias("raw"),
            x["domain"].alias("domain"),
            F.concat(
                F.when(
                    x["domain"].isin(*DOTLESS_DOMAINS),
                    F.replace(F.split_part(x["local"], F.lit("+"), F.lit(1)), F.lit("."), F.lit("")),
                ).otherwise(x["local"]),
                F.lit("@"),
                x["domain"],
            ).alias("whole"),
        ),
    )
    return F.transform(
        bare,
        lambda x: F.struct(
            x["raw"].alias("raw"),
            x["domain"].alias("domain"),
            F.when(x["whole"].rlike(VALID), x["whole"]).alias("canonical"),
        ),
    )


def canonical_email(value: Column | str) -> Column:
    """The normalised address, or null when it is not a valid one."""
    return F.get(address_facts(F.array(lowered(value))), F.lit(0))["canonical"]


def email_domain(value: Column | str) -> Column:
    """Lower-cased text after the first ``@``; empty when there is none. Not validated."""
    return F.coalesce(strip(F.get(F.split(lowered(value), "@", 2), F.lit(1))), F.lit(""))


def is_valid_email(value: Column | str) -> Column:
    return canonical_email(value).isNotNull()


def emails_in_text(value: Column | str) -> Column:
    """Every address-like token of a text, as an array (input for canonical_email).

    A match may only start where a token starts and never gives characters back, so that long runs of
    letters without an ``@`` are read once.
    """
    token = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+"
    text = as_col(value)
    found = F.when(text.contains("@"), F.regexp_extract_all(text, F.lit(token), F.lit(0)))
    return F.coalesce(found, F.array().cast("array<string>"))
