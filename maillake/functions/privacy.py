"""Masking of addresses and logins for logs and shared tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import as_col, strip


def _split_at(value: Column) -> tuple[Column, Column]:
    at = F.instr(value, "@")
    return F.substr(value, F.lit(1), at - 1), F.substr(value, at + 1)


def mask_email(value: Column | str) -> Column:
    """First character of the local part, then stars; empty when there is no ``@``."""
    addr = as_col(value)
    local, domain = _split_at(addr)
    first = F.left(strip(local), F.lit(1))
    shown = F.when(first == "", F.lit("*@")).otherwise(F.concat(first, F.lit("***@")))
    return F.when(F.instr(addr, "@") > 0, F.concat(shown, domain)).otherwise(F.lit(""))


def mask_login(value: Column | str) -> Column:
    """Like mask_email, but one-character names become a single star and plain names are kept short."""
    login = as_col(value)
    name, domain = _split_at(login)
    hidden = F.when(F.length(name) <= 1, F.repeat(F.lit("*"), F.length(name))).otherwise(
        F.concat(F.left(name, F.lit(1)), F.lit("***"))
    )
    return F.when(F.instr(login, "@") > 0, F.concat(hidden, F.lit("@"), domain)).otherwise(
        F.concat(F.left(login, F.lit(1)), F.lit("***"))
    )
