"""Parsing, bodies, attachments and export of MIME messages."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from maillake import schemas
from maillake.functions.clean import collapse
from maillake.operators import attachments, enrich, lineage, mime, quality
from maillake.operators.content_store import ContentStore
from maillake.operators.lineage import Scratch
from maillake.plans import export
from maillake.sources import sinks

from . import views
from .registry import query
from .texts import _NO_SCRIPTS, _bare

RAW = f"with raw as ({views.RAW_SQL})"
# The text of a page, white space collapsed.
TEXT = _bare(f"regexp_replace(regexp_replace({_NO_SCRIPTS}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')")


def _people(column: str):
    pairs = F.transform(column, lambda a: F.concat(a["name"], F.lit("<"), a["email"], F.lit(">")))
    return F.array_join(pairs, "|").alias(column)


HEADER_SQL = """page_id as uid_n, mailbox, 'p' || page_id || '@mail.example' as message_id,
    'q' || (page_id % 7) || '@mail.example' as in_reply_to,
    'r' || (page_id % 5) || '@mail.example|q' || (page_id % 7) || '@mail.example' as "references",
    'Re: Seite é ' || page_id as subject, 'Seite é ' || page_id as subject_canonical,
    'Sender, ' || page_id as from_name, 's' || (page_id % 13) || '@shop.example' as from_email,
    '<agent@agency.example>|Bob ' || page_id || '<bob@b.example>' as "to", 'Jörg<j' || page_id || '@c.example>' as cc, '' as bcc,
    'Mon, 15 Jan 2024 ' || lpad((page_id % 24)::varchar, 2, '0') || ':30:00 +0100' as date_header,
    strftime(timestamp '2024-01-14 23:30:00' + to_hours((page_id % 24)::integer), '%Y-%m-%dT%H:%M:%SZ') as date_utc"""


def _header_columns(parsed):
    return parsed.select(
        "uid_n",
        "mailbox",
        "message_id",
        "in_reply_to",
        F.array_join("references", "|").alias("references"),
        "subject",
        "subject_canonical",
        F.col("from.name").alias("from_name"),
        F.col("from.email").alias("from_email"),
        _people("to"),
        _people("cc"),
        _people("bcc"),
        "date_header",
        "date_utc",
    )


@query("parse_headers", f"{RAW} select {HEADER_SQL} from raw where v not in (7, 8)")
def parse_headers(spark, sf_dir):
    parsed = mime.parse_headers(views.raw_mail(spark, sf_dir))
    good, _ = quality.split_bad_rows(parsed)
    return _header_columns(good)


@query(
    "header_blocks",
    f"{RAW} select page_id as uid_n, (v <> 7) as ends_blank, (v not in (5, 7, 8)) as body_left_out from raw",
)
def header_blocks(spark, sf_dir):
    """The header scan ends with the first blank line: nothing of the body is kept and no header is lost."""
    cut = views.raw_mail(spark, sf_dir).withColumn("block", mime.header_block("content"))
    text = F.decode("block", "UTF-8")
    exact = text.endswith("\r\n\r\n") & (F.regexp_count(text, F.lit("\r\n\r\n")) == 1)
    shorter = F.octet_length("block") < F.octet_length("content")
    return cut.select(
        "uid_n",
        F.coalesce(exact, F.lit(False)).alias("ends_blank"),
        F.coalesce(shorter, F.lit(False)).alias("body_left_out"),
    )


@query(
    "mime_parts",
    f"""{RAW}, parts as (
        select page_id, 1 as part_index, v in (0, 1, 2, 3, 6) as is_multipart,
            case v when 1 then 'multipart/alternative' when 4 then 'text/html' when 5 then 'text/plain' else 'multipart/mixed' end as content_type,
            case when v = 4 then octet_length(encode(html)) when v = 5 then 0 end as size from raw where v < 7
        union all select page_id, 2, v = 3, case v when 0 then 'text/html' when 3 then 'message/rfc822' when 6 then 'application/pdf' else 'text/plain' end,
            case when v in (0, 6) then octet_length(encode(html)) when v in (1, 2) then octet_length(encode(url)) end from raw where v in (0, 1, 2, 3, 6)
        union all select page_id, 3, false, case when v in (1, 2) then 'text/html' else 'text/plain' end,
            case when v in (1, 2) then octet_length(encode(html)) else octet_length(encode(url)) end from raw where v in (0, 1, 2, 3))
    select page_id as uid_n, part_index::integer as part_index, is_multipart, content_type, coalesce(size, -1)::bigint as size from parts""",
)
def mime_parts(spark, sf_dir):
    parts = mime.explode_parts(mime.parse_messages(views.raw_mail(spark, sf_dir)), "uid_n")
    size = F.coalesce("size", F.lit(-1).cast("long")).alias("size")
    return parts.select("uid_n", "part_index", "is_multipart", "content_type", size)


BODY_SQL = f"""{RAW} select page_id as uid_n,
    case v when 1 then url when 3 then url when 5 then '' when 6 then '' else {TEXT} end as body_text,
    case when v in (0, 2, 4) then html else '' end as body_html from raw where v < 7"""


@query("body_choice", BODY_SQL)
def body_choice(spark, sf_dir):
    good, _ = quality.split_bad_rows(mime.parse_messages(views.raw_mail(spark, sf_dir)))
    return good.select("uid_n", collapse("body_text").alias("body_text"), "body_html")


@query("body_choice_flat", BODY_SQL.replace(TEXT, _bare(f"regexp_replace({_NO_SCRIPTS}, '(?s)<[^>]+>', ' ', 'g')")))
def body_choice_flat(spark, sf_dir):
    """HTML-only bodies with the one-line text, which needs no HTML parser in Python."""
    good, _ = quality.split_bad_rows(mime.parse_messages(views.raw_mail(spark, sf_dir), html_mode="flat"))
    return good.select("uid_n", "body_text", "body_html")


@query(
    "inline_parts",
    f"""{RAW} select mailbox, count(*)::bigint as parts, sum(octet_length(encode(url)))::bigint as bytes from raw where v = 2 group by mailbox""",
)
def inline_parts(spark, sf_dir):
    """Inline text never becomes the body; it is an attachment."""
    parts = mime.explode_parts(mime.parse_messages(views.raw_mail(spark, sf_dir)))
    inline = parts.where((F.col("disposition") == "inline") & (F.col("content_type") == "text/plain"))
    return inline.groupBy("mailbox").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("bytes"))


FILES = f"""{RAW}, files as (
    select page_id, uid, mailbox, 3 as part_index, 'u' || page_id || '.txt' as filename, 'text/plain' as content_type, url as body, null as content_id from raw where v = 0
    union all select page_id, uid, mailbox, 2, '', 'text/plain', url, null from raw where v = 2
    union all select page_id, uid, mailbox, 2, 'a_b_' || page_id || '.pdf', 'application/pdf', html, 'c' || page_id from raw where v = 6)"""


def _files(spark, sf_dir, **options):
    return attachments.inventory(mime.parse_messages(views.raw_mail(spark, sf_dir), **options), "uid_n", "mailbox", "uid")


@query(
    "attachment_records",
    f"""{FILES} select page_id as uid_n, filename, content_type, octet_length(encode(body))::bigint as size, sha256(body) as sha256,
        null::varchar as saved_path, content_id from files""",
)
def attachment_records(spark, sf_dir):
    return attachments.exploded(mime.parse_messages(views.raw_mail(spark, sf_dir)), "uid_n")


@query(
    "attachment_names",
    f"""{FILES} select page_id as uid_n, part_index::integer as part_index, filename, case content_type
        when 'application/pdf' then 'a_b_' || page_id || '_' || uid || '_2.pdf'
        else case when filename = '' then case mailbox
                when 'INBOX.Sent' then 'attachment_INBOX_' || uid || '_2.Sent_' || uid || '_2'
                else 'attachment_' || mailbox || '_' || uid || '_2_' || uid || '_2' end
            else 'u' || page_id || '_' || uid || '_3.txt' end end as stored_name from files""",
)
def attachment_names(spark, sf_dir):
    return _files(spark, sf_dir).select("uid_n", "part_index", "filename", "stored_name")


@query(
    "attachment_rollup",
    f"""{FILES} select mailbox, content_type, count(*)::bigint as attachments, sum(octet_length(encode(body)))::bigint as bytes,
        count(distinct sha256(body))::bigint as contents from files group by mailbox, content_type""",
)
def attachment_rollup(spark, sf_dir):
    return attachments.rollup(_files(spark, sf_dir), "mailbox", "content_type")


@query(
    "attachment_dedup",
    f"""{FILES} select sha256(body) as sha256, count(*)::bigint as uses, min(octet_length(encode(body)))::bigint as size,
        count(distinct filename)::bigint as names, min(filename) as first_name,
        (min(octet_length(encode(body))) * (count(*) - 1))::bigint as saved_bytes from files group by 1""",
)
def attachment_dedup(spark, sf_dir):
    return attachments.dedup(_files(spark, sf_dir))


@query(
    "attachment_content_names",
    f"""{FILES} select sha256(body) as sha256, filename, count(*)::bigint as uses from files group by 1, 2""",
)
def attachment_content_names(spark, sf_dir):
    return attachments.content_names(_files(spark, sf_dir))


@query(
    "attachment_store",
    f"""{FILES} select sha256(body) as sha256, substr(sha256(body), 1, 1) as prefix, min(octet_length(encode(body)))::bigint as size,
        sha256(min(body)) as stored_hash from (select body from files union all select 'logo' from raw) group by 1, 2""",
)
def attachment_store(spark, sf_dir):
    """All attachments stored with their bytes, then each content once, read back."""
    scratch = Scratch(spark, "attachment-store")
    attachments.write_table(_with_logo(spark, sf_dir), scratch.path("table"))
    attachments.write_store(spark.read.parquet(scratch.path("table")), scratch.path("store"))
    stored = spark.read.parquet(scratch.path("store")).withColumn("prefix", F.col("prefix").cast("string"))
    return stored.select("sha256", "prefix", "size", F.sha2("payload", 256).alias("stored_hash"))


def _with_logo(spark, sf_dir):
    """The attachments, and one content in most messages: a small file that every message has besides its own."""
    files = _files(spark, sf_dir, keep_payload=True)
    logo = views.raw_mail(spark, sf_dir).select(
        "uid_n", "mailbox", "uid", F.lit(99).alias("part_index"), F.lit("logo.png").alias("filename"),
        F.lit("image/png").alias("content_type"), F.lit(4).cast("long").alias("size"),
        F.sha2(F.lit("logo"), 256).alias("sha256"), F.lit(None).cast("string").alias("content_id"),
        F.lit("logo").cast("binary").alias("payload"), F.lit("logo.png").alias("stored_name"),
    )
    return files.unionByName(logo)


@query(
    "attachment_store_append",
    f"""{FILES}, every as (select page_id, body from files union all select page_id, 'logo' from raw), firsts as (
        select body, min(case when page_id % 3 = 0 then 0 when page_id % 3 = 1 then 1 else 2 end) as batch from every group by body)
    select sha256(body) as sha256, substr(sha256(body), 1, 3) as prefix, octet_length(encode(body))::bigint as size,
        sha256(body) as stored_hash, (select count(*) from firsts f where f.batch = firsts.batch)::bigint as new_in_batch from firsts""",
)
def attachment_store_append(spark, sf_dir):
    """Three batches that share contents: each content is stored once, by the batch that brings it first."""
    scratch = Scratch(spark, "content-store")
    whole = scratch.write(_with_logo(spark, sf_dir), "table")
    store = ContentStore(spark, scratch.path("store"), least_contents=64)
    for batch in (whole.where("uid_n % 3 = 0"), whole.where("uid_n % 3 <> 2"), whole):
        store.append(batch)
    named = store.contents().join(store.history(), "batch")
    return named.select("sha256", "prefix", "size", F.sha2("payload", 256).alias("stored_hash"), F.col("contents").alias("new_in_batch"))


@query("quarantine_counts", f"""{RAW} select case v when 7 then 'scan' when 8 then 'headers' when 9 then 'body' else 'ok' end as stage,
    count(*)::bigint as messages from raw group by 1""")
def quarantine_counts(spark, sf_dir):
    return quality.quarantine_counts(mime.parse_messages(views.raw_mail(spark, sf_dir)))


@query("quarantine_rows", f"""{RAW} select mailbox, uid, case v when 7 then 'scan' when 8 then 'headers' else 'body' end as stage from raw where v > 6""")
def quarantine_rows(spark, sf_dir):
    _, bad = quality.split_bad_rows(mime.parse_messages(views.raw_mail(spark, sf_dir)))
    return bad.select("mailbox", "uid", "stage")


HEADER_JOIN = f"""with src as ({views.mail_sql('uid_n', 'mailbox', 'uid', 'message_id_raw', 'subject_raw')}),
    headers as (select mailbox, case when uid_n % 3 = 1 then 'x' || uid else uid end as uid, uid_n,
        case when uid_n % 6 = 0 then null else 'H ' || subject_raw end as header_subject from src)
    select s.uid_n, case when h.uid_n is not null then h.header_subject else s.subject_raw end as subject,
        case when s.uid_n % 4 = 1 then 'known' else trim(lower(s.message_id_raw), '<>') end as conversation_id
    from src s left join headers h using (mailbox, uid)"""


def header_parts(spark, sf_dir):
    """Full messages, separately parsed headers and known conversation ids.

    A third of the header records belong to other uids: they are dropped, and those messages keep their own.
    """
    mail = views.headers(spark, sf_dir)
    full = mail.withColumn("conversation_id", F.col("message_id"))
    headers = mail.withColumns(
        {
            "uid": F.when(F.col("uid_n") % 3 == 1, F.concat(F.lit("x"), F.col("uid"))).otherwise(F.col("uid")),
            "subject": F.when(F.col("uid_n") % 6 != 0, F.concat(F.lit("H "), F.col("subject"))),
        }
    )
    known = mail.select(
        "mailbox", "uid", F.when(F.col("uid_n") % 4 == 1, F.lit("known")).otherwise(F.lit("")).alias("conversation_id")
    )
    return full, headers, known


@query("header_full_join", HEADER_JOIN)
def header_full_join(spark, sf_dir):
    full, headers, known = header_parts(spark, sf_dir)
    joined = enrich.with_known_conversation(enrich.with_headers(full, headers), known)
    return joined.select("uid_n", "subject", "conversation_id")


@query(
    "header_full_join_repeated",
    f"""with src as ({views.mail_sql('uid_n', 'mailbox', 'uid', 'message_id_raw', 'subject_raw')}), twice as (
        select * from src union all select * from src where mailbox = 'INBOX')
    select uid_n, mailbox, case when mailbox = 'INBOX' then 'B ' else 'A ' end || subject_raw as subject,
        case when mailbox = 'INBOX' then 'second' else 'first' end as conversation_id from twice""",
)
def header_full_join_repeated(spark, sf_dir):
    """A mailbox named twice has two header records per message: the last one counts, and no row is repeated."""
    mail = Scratch(spark, "headers").write(views.headers(spark, sf_dir), "mail")  # read eight times
    again = mail.where("mailbox = 'INBOX'").withColumn("mailbox_ord", F.lit(7))
    full = mail.unionByName(again).withColumn("conversation_id", F.col("message_id"))
    first = mail.withColumn("subject", F.concat(F.lit("A "), "subject"))
    headers = first.unionByName(again.withColumn("subject", F.concat(F.lit("B "), "subject"))).unionByName(first)
    known = headers.select(
        "mailbox", "uid", "mailbox_ord", F.when(F.col("mailbox_ord") == 7, "second").otherwise("first").alias("conversation_id")
    )
    joined = enrich.with_known_conversation(enrich.with_headers(full, headers), known)
    return joined.select("uid_n", "mailbox", "subject", "conversation_id")


@query(
    "saved_attachment_files",
    f"""{FILES}, twice as (select * from files union all select * replace ('INBOX Sent' as mailbox) from files where mailbox = 'INBOX.Sent')
    select uid, mailbox, part_index::integer as part_index, sha256(body) as sha256, sha256(body) as file_sha256 from twice""",
)
def saved_attachment_files(spark, sf_dir):
    """Files of mailboxes whose names look alike, with equal uids, saved and read back."""
    files = Scratch(spark, "files").write(_files(spark, sf_dir, keep_payload=True), "parsed")  # read three times
    alike = files.where("mailbox = 'INBOX.Sent'")
    both = files.where("mailbox <> 'INBOX.Sent'").unionByName(alike.withColumn("mailbox", F.lit("INBOX/Sent")))
    both = both.unionByName(alike.withColumn("mailbox", F.lit("INBOX Sent")))
    root = lineage.shared_folder(spark).removeprefix("file://")
    folder = f"{root}/saved-files-{uuid.uuid4().hex}"
    saved = Scratch(spark, "saved").write(attachments.save_files(both, folder), "records")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{folder}")
    read = found.select(F.regexp_replace("path", "^file:/+", "/").alias("saved_path"), F.sha2("content", 256).alias("file_sha256"))
    named = F.when(F.col("mailbox") == "INBOX/Sent", "INBOX.Sent").otherwise(F.col("mailbox")).alias("mailbox")
    return saved.join(read, "saved_path").select("uid", named, "part_index", "sha256", "file_sha256")


EXPORT_SQL = f"""{RAW}, good as (select *, 's' || (page_id % 13) || '@shop.example' as customer from raw where v < 7)
select uid, mailbox, 'p' || page_id || '@mail.example' as message_id,
    sha256('pair:agent@agency.example|' || customer) as conversation_id, customer as customer_email_normalized,
    case when page_id % 13 = 0 then '' when page_id % 13 % 2 = 0 then 'CRM-' || (page_id % 13) else customer end as customer_id,
    case when page_id % 13 = 0 then null else sha256('customer|acme|' || case when page_id % 13 % 2 = 0 then 'CRM-' || (page_id % 13) else customer end) end as session_id,
    'Re: Seite é ' || page_id as subject, 'Seite é ' || page_id as subject_canonical,
    strftime(timestamp '2024-01-14 23:30:00' + to_hours((page_id % 24)::integer), '%Y-%m-%dT%H:%M:%SZ') as date_utc,
    'Sender, ' || page_id as from_name, 2::bigint as recipients, 2::bigint as "references",
    case v when 1 then url when 3 then url when 5 then '' when 6 then '' else {TEXT} end as body_text,
    case when v in (0, 2, 4) then html else '' end as body_html,
    (case when v in (0, 2, 6) then 1 else 0 end)::bigint as attachments,
    '\\Seen' as flags, '2024-02-01T00:00:00Z' as fetch_ts_utc, null::varchar as provider_thread_id, 23::bigint as fields from good"""


def _exported(spark, sf_dir, headers=None, tables=None):
    # Parsed once: the look-up of customers reads the messages more than once, as in ``ExportJob``.
    parsed = export.slim(mime.parse_messages(views.raw_mail(spark, sf_dir)), False)
    good, _ = quality.split_bad_rows((tables or Scratch(spark, "export-parsed")).write(parsed, "staging"))
    flagged = good.withColumn("flags", F.array(F.lit("\\Seen")))
    crm = views.table(spark, sf_dir, "customer").selectExpr(
        "case when c_custkey % 2 = 0 then 's' else 'lead' end || c_custkey || '@shop.example' as email",
        "case when c_custkey = 0 then '' else 'CRM-' || c_custkey end as customer_id",
    )
    return export.to_export(flagged, crm, views.AGENCY, "acme", "2024-02-01T00:00:00Z", ("mailbox", "uid"), headers)


def _export_columns(df, fields):
    return df.select(
        "uid", "mailbox", "message_id", "conversation_id", "customer_email_normalized", "customer_id", "session_id",
        "subject", "subject_canonical", "date_utc", F.col("from.name").alias("from_name"),
        F.size("to").cast("long").alias("recipients"), F.size("references").cast("long").alias("references"),
        collapse("body_text").alias("body_text"), "body_html", F.size("attachments").cast("long").alias("attachments"),
        F.array_join("flags", "|").alias("flags"), "fetch_ts_utc", "provider_thread_id",
        fields.cast("long").alias("fields"),
    )


def _read_lines(spark, path):
    """Exported lines with their fields counted, nulls included."""
    read = spark.read.text(path).select(
        F.from_json("value", schemas.EXPORT).alias("record"), F.size(F.json_object_keys("value")).alias("keys")
    )
    return _export_columns(read.select("record.*", "keys"), F.col("keys"))


@query("export_records", EXPORT_SQL)
def export_records(spark, sf_dir):
    """A header pass, then the full messages to records, written in order as NDJSON and read back."""
    tables = Scratch(spark, "export-records")
    headers, _ = quality.split_bad_rows(mime.parse_headers(views.raw_mail(spark, sf_dir)))
    found = tables.write(_exported(spark, sf_dir, tables.write(headers, "headers"), tables), "records")
    # Wide rows are shuffled by the look-up and by the sort; what a step does not read any more goes before the next one.
    tables.drop("staging", "headers")
    sinks.write_ndjson(export.in_order(found).select(*schemas.EXPORT_FIELDS), tables.path("messages"))
    tables.drop("records")
    return _read_lines(spark, tables.path("messages"))


@query("export_ndjson", EXPORT_SQL)
def export_ndjson(spark, sf_dir):
    """The export written as NDJSON and read back; every line must hold every field, nulls included."""
    path = Scratch(spark, "export").path("messages")
    sinks.write_ndjson(_exported(spark, sf_dir).drop("mailbox_ord", "uid_n"), path)
    return _read_lines(spark, path)


FLOW_SQL = f"""{RAW}, good as (select *, 's' || (page_id % 13) || '@shop.example' as customer from raw where v < 7)
select uid, mailbox, 'p' || page_id || '@mail.example' as message_id, 'q' || (page_id % 7) || '@mail.example' as in_reply_to,
    'r' || (page_id % 5) || '@mail.example|q' || (page_id % 7) || '@mail.example' as "references",
    sha256('pair:agent@agency.example|' || customer) as conversation_id, customer as customer_email_normalized,
    customer as customer_id, sha256('customer|acme|' || customer) as session_id,
    'Re: Seite é ' || page_id as subject, 'Seite é ' || page_id as subject_canonical,
    strftime(timestamp '2024-01-14 23:30:00' + to_hours((page_id % 24)::integer), '%Y-%m-%dT%H:%M:%SZ') as date_utc,
    'Mon, 15 Jan 2024 ' || lpad((page_id % 24)::varchar, 2, '0') || ':30:00 +0100' as date_header,
    'Sender, ' || page_id || '<s' || (page_id % 13) || '@shop.example>' as "from",
    '<agent@agency.example>|Bob ' || page_id || '<bob@b.example>' as "to", 'Jörg<j' || page_id || '@c.example>' as cc, '' as bcc,
    case v when 1 then url when 3 then url when 5 then '' when 6 then '' else {TEXT} end as body_text,
    case when v in (0, 2, 4) then html else '' end as body_html,
    case v when 0 then 'u' || page_id || '.txt:' || sha256(url) when 2 then ':' || sha256(url)
        when 6 then 'a_b_' || page_id || '.pdf:' || sha256(html) else '' end as attachments,
    '' as flags, true as fetched, null::varchar as provider_thread_id,
    row_number() over (order by case mailbox when 'Archive' then 0 else 1 end, page_id, uid) as place
from good where mailbox in ('INBOX', 'Archive')"""


def placed(lines):
    """Lines with their ``place`` of all: files follow each other in name order, their pieces by where they begin (``_from``).

    One task reads a piece, so its lines have the numbers (``_at``) from its first one on: only a row per piece is sorted.
    """
    pieces = lines.groupBy("_file", "_from").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_from").rowsBetween(Window.unboundedPreceding, -1))
    starts = pieces.select("_file", "_from", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return lines.join(F.broadcast(starts), ["_file", "_from"]).withColumn("place", F.col("_before") + F.col("_at") - F.col("_first") + 1)


@query("export_job", FLOW_SQL)
def export_job(spark, sf_dir):
    """The whole flow over landed Parquet, in order, with all fields; the run's time is only checked for its form."""
    tables = Scratch(spark, "export-job")
    views.raw_mail(spark, sf_dir).drop("mailbox_ord").write.parquet(tables.path("raw"))
    job = export.ExportJob(
        tables.path("raw"), tables.path("out"), ["Archive", "Nowhere", "INBOX"], agency_domains=",".join(views.AGENCY), tenant="acme", ordered=True
    )
    job.run(spark)
    lines = sinks.read_ndjson(spark, tables.path("out/messages"))
    lines = lines.select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_at")
    )
    lines = placed(tables.write(lines, "lines"))
    files = F.transform("attachments", lambda a: F.concat(a["filename"], F.lit(":"), a["sha256"]))
    box = F.concat(F.col("from.name"), F.lit("<"), F.col("from.email"), F.lit(">"))
    return lines.select(
        "uid", "mailbox", "message_id", "in_reply_to", F.array_join("references", "|").alias("references"), "conversation_id",
        "customer_email_normalized", "customer_id", "session_id", "subject", "subject_canonical", "date_utc", "date_header",
        box.alias("from"), _people("to"), _people("cc"), _people("bcc"), collapse("body_text").alias("body_text"), "body_html",
        F.array_join(files, "|").alias("attachments"), F.array_join("flags", "|").alias("flags"),
        F.col("fetch_ts_utc").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$").alias("fetched"), "provider_thread_id", "place",
    )
