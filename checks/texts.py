"""Subjects, ids, dates and HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from maillake.functions import dates, ids, subjects, words
from maillake.functions.dates import MONTHS
from maillake.operators import text

from . import sqltext, views
from .registry import query


@query(
    "canonical_subjects",
    f"""with src as ({views.mail_sql('mailbox', 'subject_raw')})
    select {sqltext.subject('subject_raw')} as subject, count(*)::bigint as messages, count(distinct mailbox)::bigint as mailboxes
    from src group by 1""",
)
def canonical_subjects(spark, sf_dir):
    src = views.mail_src(spark, sf_dir).select("mailbox", subjects.canonical_subject("subject_raw").alias("subject"))
    return src.groupBy("subject").agg(
        F.count(F.lit(1)).alias("messages"), F.countDistinct("mailbox").alias("mailboxes")
    )


@query(
    "decoded_subjects",
    """select page_id, case when page_id % 2 = 0 then 'Seite é ' || page_id else 'plain ' || page_id end as subject from pages""",
)
def decoded_subjects(spark, sf_dir):
    """Encoded words in a column of headers; the plain ones do not cross into Python."""
    pages = views.spread(views.table(spark, sf_dir, "pages"), "page_id").selectExpr(
        "page_id",
        "case when page_id % 2 = 0 then '=?utf-8?b?' || base64(encode('Re: Seite é ' || page_id, 'utf-8')) || '?=' "
        "else 'Fwd: plain ' || page_id end as header",
    )
    return pages.select("page_id", subjects.canonical_subject(words.decode_words("header")).alias("subject"))


@query(
    "extract_message_ids",
    f"""with src as ({views.mail_sql('uid_n', 'references_raw')})
    select uid_n, array_to_string({sqltext.ids('references_raw')}, '|') as ids, len({sqltext.ids('references_raw')})::bigint as n from src""",
)
def extract_message_ids(spark, sf_dir):
    found = views.mail_src(spark, sf_dir).select("uid_n", ids.extract_ids("references_raw").alias("ids"))
    return found.select("uid_n", F.array_join("ids", "|").alias("ids"), F.size("ids").cast("long").alias("n"))


@query(
    "first_message_id",
    f"""with src as ({views.mail_sql('uid_n', 'references_raw', 'message_id_raw')})
    select uid_n, {sqltext.ids('references_raw')}[1] as first_reference, {sqltext.ids('message_id_raw')}[1] as message_id from src""",
)
def first_message_id(spark, sf_dir):
    return views.mail_src(spark, sf_dir).select(
        "uid_n", ids.first_id("references_raw").alias("first_reference"), ids.first_id("message_id_raw").alias("message_id")
    )


@query(
    "canonical_message_ids",
    f"""with src as ({views.mail_sql('in_reply_to_raw')})
    select nullif(trim(lower(in_reply_to_raw), '<>'), '') as message_id, count(*)::bigint as messages from src group by 1""",
)
def canonical_message_ids(spark, sf_dir):
    src = views.mail_src(spark, sf_dir)
    return src.groupBy(ids.canonical_id("in_reply_to_raw").alias("message_id")).agg(F.count(F.lit(1)).alias("messages"))


# Mail dates made of event times, in seven writings; the last is not a date.
_ZONES = ("+0100", "-0530", "-0000", "", "EST", "+0000 (UTC)")


@query(
    "parse_dates_utc",
    """select event_id, case event_id % 7
            when 0 then strftime(date_trunc('second', ts) - interval 1 hour, '%Y-%m-%dT%H:%M:%SZ')
            when 1 then strftime(date_trunc('second', ts) + interval 330 minute, '%Y-%m-%dT%H:%M:%SZ')
            when 4 then strftime(date_trunc('second', ts) + interval 5 hour, '%Y-%m-%dT%H:%M:%SZ')
            when 6 then null
            else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end as date_utc from events""",
)
def parse_dates_utc(spark, sf_dir):
    months = ", ".join(f"'{m}'" for m in MONTHS)
    zones = " ".join(f"when {i} then ' {z}'" for i, z in enumerate(_ZONES))
    days = "case when event_id % 2 = 0 then element_at(array('Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'), dayofweek(ts)) || ', ' else '' end"
    headers = views.spread(views.table(spark, sf_dir, "events").select("event_id", "ts"), "event_id").selectExpr(
        "event_id",
        f"case when event_id % 7 = 6 then 'some day ' || event_id else {days} || day(ts) || ' ' || element_at(array({months}), month(ts)) "
        f"|| ' ' || year(ts) || ' ' || substr(cast(ts as string), 12, 8) || rtrim(case event_id % 7 {zones} end) end as header",
    )
    return headers.select("event_id", dates.to_utc("header").alias("date_utc"))


@query(
    "date_buckets",
    f"""with src as ({views.mail_sql('uid_n', 'sent_ts')})
    select case when uid_n % 10 = 3 then 'unknown' when uid_n % 10 = 4 then strftime(sent_ts + interval 1 day, '%Y-%m-%d')
        else strftime(sent_ts, '%Y-%m-%d') end as day, count(*)::bigint as messages from src group by 1""",
)
def date_buckets(spark, sf_dir):
    """UTC days; every tenth text is no date and every tenth is late in the evening west of UTC."""
    src = views.mail_src(spark, sf_dir).selectExpr(
        "case uid_n % 10 when 3 then 'no date' when 4 then substr(cast(sent_ts as string), 1, 10) || 'T22:00:00-05:00' "
        "else substr(cast(sent_ts as string), 1, 10) || 'T00:00:00Z' end as date_utc"
    )
    return src.groupBy(dates.day_bucket("date_utc").alias("day")).agg(F.count(F.lit(1)).alias("messages"))


def _bare(tag_free: str) -> str:
    """Entities decoded, with or without their semicolon (cut-off titles leave it out), and white space collapsed."""
    decoded = tag_free
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        decoded = f"regexp_replace({decoded}, '&{name};?', '{char}', 'g')"
    return f"trim(regexp_replace({decoded}, '[\\s\\x{{a0}}]+', ' ', 'g'))"


_NO_SCRIPTS = (
    "regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>', '', 'g'), '(?is)<style.*?>.*?</style>', '', 'g')"
)


@query(
    "html_text_flat",
    f"""with texts as (select page_id, {_bare(f"regexp_replace({_NO_SCRIPTS}, '(?s)<[^>]+>', ' ', 'g')")} as text from pages)
    select page_id, text, length(text)::bigint as chars from texts""",
)
def html_text_flat(spark, sf_dir):
    pages = views.spread(views.table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    found = text.html_to_text(pages, "html", mode="flat")
    return found.select("page_id", "text", F.length("text").cast("long").alias("chars"))


@query(
    "html_text_nodes",
    f"""with texts as (select page_id, {_bare(f"regexp_replace(regexp_replace({_NO_SCRIPTS}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')")} as text from pages)
    select page_id, text, length(text)::bigint as chars from texts""",
)
def html_text_nodes(spark, sf_dir):
    """Compared with white space collapsed; the line structure is covered by tests."""
    from maillake.functions.clean import collapse

    pages = views.spread(views.table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    found = text.html_to_text(pages, "html", mode="nodes").select("page_id", collapse("text").alias("text"))
    return found.select("page_id", "text", F.length("text").cast("long").alias("chars"))
