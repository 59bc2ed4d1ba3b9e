"""Mail dates: header text to UTC text, and day buckets. Nothing here depends on the session time zone."""

from __future__ import annotations

from datetime import datetime, timedelta
from email.utils import parsedate_tz

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .clean import as_col

# Month names of mail dates and the common header form. Anything else takes the slow path.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
COMMON_FORM = (
    r"\A(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), )?(\d{1,2}) (" + "|".join(MONTHS) + r") ((?:19|20)\d\d) "
    r"([01]\d|2[0-3]):([0-5]\d)(?::([0-5]\d))?(?: ([+-])(\d\d)(\d\d))?(?: \([A-Za-z]+\))?\z"
)


def utc_text(header: str | None) -> str | None:
    """One mail date as UTC ISO text, or None. A missing zone means UTC."""
    fields = parsedate_tz(header) if header else None
    if fields is None:
        return None
    try:
        local = datetime(*fields[:6])
        shift = timedelta(seconds=fields[9] or 0)
        if abs(shift) >= timedelta(days=1):
            return None
        return f"{local - shift:%Y-%m-%dT%H:%M:%S}Z".rjust(20, "0")
    except (ValueError, OverflowError):  # no such day or time, or beyond the calendar
        return None


@F.pandas_udf(StringType())
def _utc_text(headers: pd.Series) -> pd.Series:
    return headers.map(utc_text, na_action="ignore").astype(object)


def to_utc_common(header: Column | str) -> Column:
    """UTC text for headers in the common form, else null. Catalyst only."""
    text = as_col(header)

    def group(i: int) -> Column:
        return F.regexp_extract(text, COMMON_FORM, i)

    def number(i: int) -> Column:
        return F.coalesce(group(i).try_cast("int"), F.lit(0))

    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), group(2)).cast("int")
    local = F.try_make_timestamp_ntz(number(3), month, number(1), number(4), number(5), number(6).cast("decimal(8,6)"))
    offset = (number(8) * 3600 + number(9) * 60) * F.when(group(7) == "-", -1).otherwise(1)
    moment = local - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), offset.cast("decimal(18,6)"))
    shown = F.concat(F.replace(moment.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    return F.when(text.rlike(COMMON_FORM) & (F.abs(offset) < 86400), shown)


def to_utc(header: Column | str) -> Column:
    """UTC text for any mail date. Headers in the common form pass through the Arrow stage as nulls."""
    text = as_col(header)
    return F.coalesce(to_utc_common(text), _utc_text(F.when(~text.rlike(COMMON_FORM), text)))


def utc_timestamp(iso: Column | str) -> Column:
    """UTC text as a zone-free timestamp for grouping and ordering; null when unparsable."""
    return F.substr(as_col(iso), F.lit(1), F.lit(19)).try_cast("timestamp_ntz")


def day_bucket(iso: Column | str) -> Column:
    """UTC day of an ISO date-time, ``unknown`` when missing or unparsable. No zone means UTC."""
    text = as_col(iso)
    zoned = (
        F.when(text.rlike(r"\A\d{4}-\d\d-\d\d\z"), F.concat(text, F.lit("T00:00:00Z")))
        .when(text.rlike(r"\A\d{4}-\d\d-\d\d.*(?:Z|[+-]\d\d:?\d\d)\z"), text)
        .when(text.rlike(r"\A\d{4}-\d\d-\d\d."), F.concat(text, F.lit("Z")))
    )
    parsed = zoned.try_cast("timestamp")
    day = F.date_from_unix_date(F.floor(F.unix_seconds(parsed) / 86400).cast("int"))
    return F.coalesce(day.cast("string"), F.lit("unknown"))
