"""Mail tables derived from the driver tables, for Spark and (as SQL text) for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maillake.functions import ids, subjects
from maillake.functions.roles import ADDRESS_LIST

AGENCY = ["agency.example"]
MAILBOXES = ("INBOX", "INBOX.Sent", "Archive")

# One message header per order. ``STR`` is the text type of the dialect. Every fourth message starts a
# thread; the others answer the message four orders before, except that some answer an unknown id, some
# answer one much-answered message and some pairs answer each other.
MAIL_COLUMNS = {
    "uid_n": "o_orderkey",
    "uid": "cast(o_orderkey as STR)",
    "mailbox": "case o_orderstatus when 'O' then 'INBOX' when 'F' then 'INBOX.Sent' else 'Archive' end",
    "mailbox_ord": "case o_orderstatus when 'O' then 0 when 'F' then 1 else 2 end",
    "from_raw": """case o_orderkey % 5 when 0 then 'Agent' || (o_custkey % 7) || '@Agency.example'
        when 1 then 'Cust.' || o_custkey || '+t' || (o_orderkey % 3) || '@Gmail.com'
        when 2 then 'cust' || o_custkey || '@shop' || (o_custkey % 20) || '.example'
        when 3 then ' Bad ' || o_orderkey || '@nodot' else '' end""",
    "to_raw": """case o_orderkey % 3 when 0 then 'agent' || (o_orderkey % 7) || '@agency.example'
        when 1 then 'cust' || o_custkey || '@shop' || (o_custkey % 20) || '.example'
        else 'not-an-address' end""",
    "cc_raw": """case o_orderkey % 4 when 0 then 'Cust.' || o_custkey || '@googlemail.com'
        when 1 then 'agent' || (o_custkey % 7) || '@agency.example' else '' end""",
    "sent_ts": "o_orderdate",
    "subject_raw": """case o_orderkey % 6 when 0 then 'Re: ' when 1 then 'FWD: Re[2]: ' when 2 then 'Antwort : '
        when 3 then 'ОТВЕТ: ' when 4 then '  Re:  aw: ' else '' end || 'Order  ' || o_custkey""",
    "message_id_raw": "'<M' || o_orderkey || '@Mail.example>'",
    "in_reply_to_raw": """case when o_orderkey % 4 = 0 or o_orderkey < 4 then null
        when o_orderkey % 97 = 0 then '<gone' || o_orderkey || '@mail.example>'
        when o_orderkey % 31 = 0 then '<M1@Mail.example>'
        when o_orderkey % 1001 = 5 then '<M' || (o_orderkey + 4) || '@Mail.example>'
        else '<M' || (o_orderkey - 4) || '@Mail.example>' end""",
    "references_raw": """case when o_orderkey % 11 = 0 then
        '<Root' || o_custkey || '@mail.example> <M' || o_orderkey || '@mail.example>' end""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key, since each input may be one small file; the plan is the same at every size.

    With a number, as adaptive execution puts small exchanges without one into a single task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def mail_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [f"{sql.replace('STR', 'string')} as {name}" for name, sql in MAIL_COLUMNS.items()]
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").selectExpr(*columns)


def mail_sql(*names: str) -> str:
    """The same as a DuckDB select, restricted to ``names`` when given."""
    chosen = names or tuple(MAIL_COLUMNS)
    columns = ", ".join(f"{MAIL_COLUMNS[n].replace('STR', 'varchar')} as {n}" for n in chosen)
    return f"select {columns} from orders"


def _box(column: str) -> F.Column:
    return F.struct(F.lit("").alias("name"), F.col(column).alias("email"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mail_src in the shape of the header table."""
    raw = mail_src(spark, sf_dir)
    return raw.select(
        "uid_n",
        "uid",
        "mailbox",
        "mailbox_ord",
        ids.header_id("message_id_raw").alias("message_id"),
        ids.header_id("in_reply_to_raw").alias("in_reply_to"),
        ids.header_ids("references_raw").alias("references"),
        F.col("subject_raw").alias("subject"),
        subjects.canonical_subject("subject_raw").alias("subject_canonical"),
        _box("from_raw").alias("from"),
        F.array(_box("to_raw")).alias("to"),
        F.array(_box("cc_raw")).alias("cc"),
        F.array().cast(ADDRESS_LIST).alias("bcc"),
        F.col("sent_ts").alias("date_ts"),
        F.lit(None).cast("string").alias("date_header"),
        F.concat(F.replace(F.col("sent_ts").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z")).alias("date_utc"),
    )


_CRM = (
    "case when c_custkey % 2 = 0 then 'cust' else 'lead' end || c_custkey || '@shop' || (c_custkey % 20) || '.example' as email",
    "case when c_custkey % 10 = 0 then '' else 'CRM-' || c_custkey end as customer_id",
)
CRM_SQL = f"select {', '.join(_CRM)} from customer"


def crm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRM map: every second customer under the address of its mails; some ids are empty."""
    return table(spark, sf_dir, "customer").selectExpr(*_CRM)


def conv_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply chains: every turn of a conversation answers the turn before."""
    chains = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id",
        "turn",
        "conv_id || '.' || turn || '@conv.example' as message_id",
        "case when turn > 0 then conv_id || '.' || (turn - 1) || '@conv.example' end as in_reply_to",
    )
    return chains.withColumn("references", F.array().cast("array<string>"))


def broken_conv_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with references at some turns, and first turns that answer an unknown message."""
    gone = "case when turn > 0 then in_reply_to when conv_id % 2 = 0 then conv_id || '.gone@conv.example' end"
    refs = "case when turn % 5 = 3 then array(conv_id || '.' || turn || '.ref@conv.example') else references end"
    return conv_mail(spark, sf_dir).selectExpr(
        "conv_id", "turn", "message_id", f"{gone} as in_reply_to", f"{refs} as references"
    )


DEEP = 10_000


def deep_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Very long chains: messages numbered by order, each answering the one before, up to DEEP of them."""
    numbered = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as n",
        "o_orderkey || '@deep.example' as message_id",
        f"case when o_orderkey % {DEEP} <> 0 then (o_orderkey - 1) || '@deep.example' end as in_reply_to",
    )
    return numbered.withColumn("references", F.array().cast("array<string>"))


# MIME messages made of pages. Every page is in a message with its HTML and its URL (variants 0 to 2); most pages are
# in an edge message too. The variant v is page_id % 10, and page_id % 3 for the second message of a page:
# 0 HTML and a text attachment      1 plain and HTML alternatives     2 inline text and HTML
# 3 forwarded message with text     4 HTML in an unknown charset      5 headers only
# 6 PDF with a name only            7 no content                      8 unreadable recipient header
# 9 unreadable attachment name
VARIANTS = 10
_HEAD = (
    "'From: \"Sender, ' || page_id || '\" <s' || (page_id % 13) || '@shop.example>\\r\\n'"
    " || 'To: ' || case when v = 8 then 'a@[' else 'agent@agency.example, Bob ' || page_id || ' <bob@b.example>' end"
    " || '\\r\\nCc: =?utf-8?q?J=C3=B6rg?= <j' || page_id || '@c.example>\\r\\n'"
    " || 'Subject: =?utf-8?b?' || base64(encode('Re: Seite é ' || page_id, 'utf-8')) || '?=\\r\\n'"
    " || 'Message-ID: <P' || page_id || '@Mail.example>\\r\\nIn-Reply-To: <Q' || (page_id % 7) || '@Mail.example>\\r\\n'"
    " || 'References: <R' || (page_id % 5) || '@Mail.example>\\r\\n <Q' || (page_id % 7) || '@Mail.example>\\r\\n'"
    " || 'Date: Mon, 15 Jan 2024 ' || lpad(cast(page_id % 24 as string), 2, '0') || ':30:00 +0100\\r\\nMIME-Version: 1.0\\r\\n'"
)
_HTML64 = "base64(encode(html, 'utf-8'))"
_URL64 = "base64(encode(url, 'utf-8'))"
_HTML_PART = (
    "'Content-Type: text/html; charset=utf-8\\r\\nContent-Transfer-Encoding: base64\\r\\n\\r\\n' || " + _HTML64 + " || '\\r\\n'"
)
_TEXT_HEAD = "Content-Type: text/plain; charset=utf-8\\r\\nContent-Transfer-Encoding: base64\\r\\n"
_MIXED = "'Content-Type: multipart/mixed; boundary=\"b0\"\\r\\n\\r\\n--b0\\r\\n'"
_NEXT = "'--b0\\r\\n'"
_END = "'--b0--\\r\\n'"
_BODIES = {
    0: f"{_MIXED} || {_HTML_PART} || {_NEXT} || 'Content-Type: text/plain; name=\"u' || page_id || '.txt\"\\r\\n"
    f"Content-Disposition: attachment; filename=\"u' || page_id || '.txt\"\\r\\nContent-Transfer-Encoding: base64\\r\\n\\r\\n' || {_URL64} || '\\r\\n' || {_END}",
    1: f"'Content-Type: multipart/alternative; boundary=\"b0\"\\r\\n\\r\\n--b0\\r\\n{_TEXT_HEAD}\\r\\n' || {_URL64} || '\\r\\n' || {_NEXT} || {_HTML_PART} || {_END}",
    2: f"{_MIXED} || '{_TEXT_HEAD}Content-Disposition: inline\\r\\n\\r\\n' || {_URL64} || '\\r\\n' || {_NEXT} || {_HTML_PART} || {_END}",
    3: f"{_MIXED} || 'Content-Type: message/rfc822\\r\\n\\r\\nSubject: inner\\r\\n{_TEXT_HEAD}\\r\\n' || {_URL64} || '\\r\\n' || {_END}",
    4: f"'Content-Type: text/html; charset=\"x-nowhere\"\\r\\nContent-Transfer-Encoding: base64\\r\\n\\r\\n' || {_HTML64} || '\\r\\n'",
    5: "'\\r\\n'",
    6: f"{_MIXED} || 'Content-Type: application/pdf; name=\"a/b:' || page_id || '.pdf\"\\r\\nContent-ID: <c' || page_id || '>\\r\\n"
    f"Content-Transfer-Encoding: base64\\r\\n\\r\\n' || {_HTML64} || '\\r\\n' || {_END}",
    8: "'\\r\\n'",
    9: "'Content-Disposition: attachment; filename*0*=\"\\'\\r\\n\\r\\nx'",
}


def raw_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW table of MIME messages; the oracles read the original pages."""
    bodies = " ".join(f"when {variant} then {sql}" for variant, sql in _BODIES.items())
    variants = "case when page_id % 10 > 2 then array(page_id % 10, page_id % 3) else array(page_id % 10) end"
    pages = spread(table(spark, sf_dir, "pages"), "page_id").selectExpr("*", f"posexplode({variants}) as (nth, v)")
    return pages.selectExpr(
        "page_id as uid_n",
        "if(nth = 0, 'p', 'q') || page_id as uid",
        "case page_id % 3 when 0 then 'INBOX' when 1 then 'INBOX.Sent' else 'Archive' end as mailbox",
        "cast(page_id % 3 as int) as mailbox_ord",
        f"case when v <> 7 then cast({_HEAD} || case v {bodies} end as binary) end as content",
    )


RAW_SQL = """select page_id, uid, v, url, html,
    case page_id % 3 when 0 then 'INBOX' when 1 then 'INBOX.Sent' else 'Archive' end as mailbox from (
        select page_id, 'p' || page_id as uid, page_id % 10 as v, url, html from pages
        union all select page_id, 'q' || page_id, page_id % 3, url, html from pages where page_id % 10 > 2)"""
