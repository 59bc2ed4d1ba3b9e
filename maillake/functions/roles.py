"""Who is the customer and who is the agent of a message.

The address list of a message is normalised once (``people``); the role builders only pick from it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .address import address_facts, email_domain, lowered
from .clean import as_col, strip

ADDRESS_LIST = "array<struct<name:string,email:string>>"


def parse_domains(text: str | None) -> list[str]:
    """Agency domains from comma-separated configuration text."""
    return sorted({d.strip() for d in (text or "").lower().split(",") if d.strip()})


def parse_domains_col(text: Column | str) -> Column:
    """The same for a text column: an array of distinct domains."""
    items = F.transform(F.split(F.lower(as_col(text)), ","), strip)
    return F.array_sort(F.array_distinct(F.filter(items, lambda d: d != "")))


def is_agency(address: Column | str, domains: Iterable[str]) -> Column:
    """True when the address has exactly one of the domains; subdomains do not count."""
    return email_domain(address).isin(*[d for d in domains if d])


def recipients(to: Column | str, cc: Column | str, bcc: Column | str) -> Column:
    """To, Cc and Bcc in that order as one list."""
    empty = F.array().cast(ADDRESS_LIST)
    return F.concat(*[F.coalesce(as_col(c), empty) for c in (to, cc, bcc)])


def people(addresses: Column | str, domains: Iterable[str]) -> Column:
    """Address list -> array<struct<raw, agency, canonical>>, same order."""
    allowed = [d for d in domains if d]
    facts = address_facts(F.transform(as_col(addresses), lambda a: lowered(a["email"])))
    return F.transform(
        facts,
        lambda f: F.struct(
            f["raw"].alias("raw"),
            f["domain"].isin(*allowed).alias("agency"),
            f["canonical"].alias("canonical"),
        ),
    )


def _first(everyone: Column, wanted: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(everyone, lambda p: (p["raw"] != "") & p["canonical"].isNotNull() & wanted(p)), F.lit(0))[
        "canonical"
    ]


def customer_email(sender: Column, others: Column) -> Column:
    """Sender outside the agency decides alone, even when invalid; else the first outside recipient."""
    outside = (sender["raw"] != "") & ~sender["agency"]
    return F.when(outside, sender["canonical"]).otherwise(_first(others, lambda p: ~p["agency"]))


def agent_email(sender: Column, others: Column) -> Column:
    """Agency sender decides alone; else the first agency recipient."""
    return F.when(sender["agency"], sender["canonical"]).otherwise(_first(others, lambda p: p["agency"]))


def first_recipient(others: Column) -> Column:
    return _first(others, lambda p: F.lit(True))


def session_id(customer_id: Column | str, tenant: str = "default") -> Column:
    """Tenant-scoped hash of the customer id; null for a null or empty id."""
    customer = as_col(customer_id)
    return F.when(customer != "", F.sha2(F.concat(F.lit(f"customer|{tenant.strip()}|"), customer), 256))
