"""Mailboxes: profile, limits, unions, response prefixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from maillake.operators import analytics, mailboxes
from maillake.operators.lineage import Scratch
from maillake.plans import profile
from maillake.sources import mbox, messages

from . import views
from .registry import query

NARROW = ("uid_n", "uid", "mailbox", "mailbox_ord")
SRC = views.mail_sql("uid_n", "uid", "mailbox")

# Requested: one without messages, one that cannot be opened.
REQUESTED = ["INBOX", "INBOX.Sent", "Empty", "Archive", "Locked", "Drafts"]
READABLE = ["INBOX", "INBOX.Sent", "Archive", "Empty"]
_ASKED = "(values " + ", ".join(f"({i}, '{m}')" for i, m in enumerate(REQUESTED)) + ") as asked(mailbox_ord, mailbox)"
_OPEN = ", ".join(f"'{m}'" for m in READABLE)


def _src(spark, sf_dir):
    return views.mail_src(spark, sf_dir).select(*NARROW)


@query(
    "mailbox_profile",
    f"""with src as ({SRC}), counts as (select mailbox, count(*) as n from src group by mailbox)
    select a.mailbox, a.mailbox_ord::integer as mailbox_ord,
        (case when a.mailbox in ({_OPEN}) then coalesce(c.n, 0) else -1 end)::bigint as messages
    from {_ASKED} left join counts c on c.mailbox = a.mailbox""".replace("a.mailbox", "asked.mailbox"),
)
def mailbox_profile(spark, sf_dir):
    readable = spark.createDataFrame([(m,) for m in READABLE], "mailbox string")
    return mailboxes.profile(_src(spark, sf_dir), mailboxes.requested(spark, REQUESTED), readable)


@query(
    "mailbox_preview",
    f"""with src as ({SRC}), names as (select distinct mailbox || '/' || (uid_n % 4) as mailbox from src),
    ordered as (select mailbox, row_number() over (order by mailbox) as pos from names)
    select count(*)::bigint as mailboxes, string_agg(mailbox, ',' order by mailbox) filter (where pos <= 5) as preview from ordered""",
)
def mailbox_preview(spark, sf_dir):
    folders = views.mail_src(spark, sf_dir).selectExpr("mailbox || '/' || (uid_n % 4) as mailbox")
    return mailboxes.preview(mailboxes.list_mailboxes(folders).withColumn("mailbox_ord", F.lit(0)))


@query("messages_per_mailbox", f"with src as ({SRC}) select mailbox, count(*)::bigint as messages from src group by mailbox")
def messages_per_mailbox(spark, sf_dir):
    return analytics.messages_per_mailbox(_src(spark, sf_dir))


def _limited(limit: int) -> str:
    return f"""with src as ({SRC}), ranked as (select *, row_number() over (partition by mailbox order by uid_n) as rn from src)
    select mailbox, uid_n from ranked where rn <= {limit}"""


@query("limit_per_mailbox", _limited(50))
def limit_per_mailbox(spark, sf_dir):
    return mailboxes.limit_per_mailbox(_src(spark, sf_dir), 50).select("mailbox", "uid_n")


@query("limit_per_mailbox_large", _limited(3000))
def limit_per_mailbox_large(spark, sf_dir):
    """A limit beyond what a window group limit covers, with narrow uid ranges."""
    return mailboxes.limit_per_mailbox(_src(spark, sf_dir), 3000, width=1000).select("mailbox", "uid_n")


# Every uid is there three times, every tenth without number, some rows are there twice.
_REPEATED = ("case when uid_n % 10 = 0 then null else DIV end as uid_n", "case when uid_n % 20 = 0 then null else cast(DIV as STR) end as uid", "mailbox", "mailbox_ord", "subject_raw")


def _repeated(spark, sf_dir):
    columns = [c.replace("DIV", "uid_n div 3").replace("STR", "string") for c in _REPEATED]
    times = F.explode(F.expr("sequence(1, if(uid_n % 7 = 0, 2, 1))")).alias("_times")
    src = views.mail_src(spark, sf_dir).select("uid_n", "mailbox", "mailbox_ord", "subject_raw", times)
    return src.selectExpr(*columns)


_REPEATED_SQL = f"""src as ({views.mail_sql('uid_n', 'mailbox', 'mailbox_ord', 'subject_raw')}), repeated as (
    select {', '.join(c.replace('DIV', 'uid_n // 3').replace('STR', 'varchar') for c in _REPEATED)}
    from src, range(2) as t(again) where again = 0 or src.uid_n % 7 = 0)"""


@query(
    "limit_per_mailbox_repeated_uids",
    f"""with {_REPEATED_SQL}, limited(n) as (values (200), (6000)), counts as (
        select mailbox, n, least(n, count(*))::bigint as messages, least(n, count(uid_n))::bigint as numbered
        from repeated, limited group by mailbox, n),
    ranked as (select mailbox, uid_n, row_number() over (partition by mailbox order by uid_n) as rn from repeated where uid_n is not null)
    select c.mailbox, c.n::integer as n, c.messages, c.numbered, sum(r.uid_n)::bigint as total
    from counts c join ranked r on r.mailbox = c.mailbox and r.rn <= c.n group by all""",
)
def limit_per_mailbox_repeated_uids(spark, sf_dir):
    """Limits that fall among equal uids, and among messages without one: exactly as many as asked for."""
    rows = _repeated(spark, sf_dir)
    both = [mailboxes.limit_per_mailbox(rows, n, width=500).withColumn("n", F.lit(n)) for n in (200, 6000)]
    counted = both[0].unionByName(both[1]).groupBy("mailbox", "n")
    return counted.agg(F.count(F.lit(1)).alias("messages"), F.count("uid_n").alias("numbered"), F.sum("uid_n").alias("total"))


@query(
    "dedup_messages_repeated_rows",
    f"""with {_REPEATED_SQL}, named as (select *, case when uid_n % 5 <> 0 then 'd' || (uid_n // 2) end as message_id from repeated),
    ranked as (select *, row_number() over (partition by message_id order by mailbox_ord, mailbox, uid_n, uid) as rn from named)
    select message_id, coalesce(uid_n, -1) as uid_n, uid, mailbox, count(*)::bigint as n from ranked where message_id is null or rn = 1 group by all""",
)
def dedup_messages_repeated_rows(spark, sf_dir):
    """A mailbox landed twice: one row of each message stays, and all rows without an id."""
    named = _repeated(spark, sf_dir).selectExpr("*", "case when uid_n % 5 <> 0 then 'd' || (uid_n div 2) end as message_id")
    kept = mailboxes.drop_repeated(named)
    kept = kept.withColumn("uid_n", F.coalesce("uid_n", F.lit(-1)))
    return kept.groupBy("message_id", "uid_n", "uid", "mailbox").agg(F.count(F.lit(1)).alias("n"))


@query(
    "select_mailboxes",
    f"""with src as ({SRC}), asked(mailbox_ord, mailbox) as (values (0, 'Archive'), (1, 'Nowhere'), (2, 'INBOX'), (3, 'Archive'))
    select src.uid_n, src.mailbox, asked.mailbox_ord::integer as mailbox_ord from src join asked using (mailbox)""",
)
def select_mailboxes(spark, sf_dir):
    """In the requested order; one is asked for twice and one does not exist."""
    names = mailboxes.parse_mailbox_list("Archive, Nowhere,INBOX,,Archive ")
    return mailboxes.select_mailboxes(_src(spark, sf_dir).drop("mailbox_ord", "uid"), names)


@query(
    "missing_mailboxes",
    f"""with src as ({SRC}) select asked.mailbox, asked.mailbox_ord::integer as mailbox_ord from {_ASKED}
    where asked.mailbox not in (select mailbox from src)""",
)
def missing_mailboxes(spark, sf_dir):
    return mailboxes.missing_mailboxes(_src(spark, sf_dir), REQUESTED)


@query(
    "union_mailboxes",
    f"""with src as ({SRC}), whole as (
        select mailbox, uid_n, 0 as mailbox_ord from src where mailbox = 'INBOX'
        union all select mailbox, uid_n, 1 from src where mailbox = 'Archive'
        union all select mailbox, uid_n, 2 from src where mailbox = 'INBOX')
    select mailbox, mailbox_ord::integer as mailbox_ord, count(*)::bigint as messages, sum(uid_n)::bigint as uid_sum from whole group by all""",
)
def union_mailboxes(spark, sf_dir):
    src = _src(spark, sf_dir).drop("mailbox_ord")
    whole = messages.union_mailboxes([src.where(F.col("mailbox") == m) for m in ("INBOX", "Archive", "INBOX")])
    return whole.groupBy("mailbox", "mailbox_ord").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("uid_n").alias("uid_sum")
    )


@query(
    "dedup_messages",
    f"""with src as ({views.mail_sql('uid_n', 'mailbox', 'mailbox_ord')}),
    keyed as (select *, case when uid_n % 10 <> 9 then 'd' || (uid_n // 3) end as message_id from src),
    ranked as (select *, row_number() over (partition by message_id order by mailbox_ord, uid_n) as rn from keyed)
    select uid_n, mailbox, message_id from ranked where rn = 1 or message_id is null""",
)
def dedup_messages(spark, sf_dir):
    keyed = views.mail_src(spark, sf_dir).selectExpr(
        "uid_n", "mailbox", "mailbox_ord", "case when uid_n % 10 <> 9 then 'd' || (uid_n div 3) end as message_id"
    )
    return mailboxes.drop_repeated(keyed).select("uid_n", "mailbox", "message_id")


TEXT_UIDS = f"""texts as (select mailbox, mailbox_ord, uid_n as n, case when uid_n % 2 = 0 then uid_n end as uid_n,
    case when uid_n % 2 = 0 then uid_n::varchar else 'p' || uid_n end as uid,
    case when uid_n % 10 <> 9 then 'd' || (uid_n // 3) end as message_id from ({views.mail_sql('uid_n', 'mailbox', 'mailbox_ord')}))"""


def _text_uids(spark, sf_dir):
    """Messages of which half have no number as uid."""
    return views.mail_src(spark, sf_dir).selectExpr(
        "mailbox",
        "mailbox_ord",
        "uid_n as n",
        "case when uid_n % 2 = 0 then uid_n end as uid_n",
        "case when uid_n % 2 = 0 then cast(uid_n as string) else 'p' || uid_n end as uid",
        "case when uid_n % 10 <> 9 then 'd' || (uid_n div 3) end as message_id",
    )


@query(
    "dedup_messages_text_uids",
    f"""with {TEXT_UIDS}, ranked as (select *, row_number() over (
        partition by message_id order by mailbox_ord, uid_n nulls last, uid) as rn from texts)
    select n, uid, mailbox, message_id from ranked where rn = 1 or message_id is null""",
)
def dedup_messages_text_uids(spark, sf_dir):
    return mailboxes.drop_repeated(_text_uids(spark, sf_dir)).select("n", "uid", "mailbox", "message_id")


@query(
    "limit_per_mailbox_text_uids",
    f"""with {TEXT_UIDS}, counted as (select *, row_number() over (
        partition by mailbox order by uid_n nulls last, md5(uid), uid) as rn, count(uid_n) over (partition by mailbox) as numbers from texts)
    select mailbox, uid from counted where rn <= 2500""",
)
def limit_per_mailbox_text_uids(spark, sf_dir):
    """The limit falls among the text uids of some mailboxes."""
    return mailboxes.limit_per_mailbox(_text_uids(spark, sf_dir), 2500).select("mailbox", "uid")


@query(
    "mailbox_profile_landed",
    f"""with src as ({SRC}), counts as (select mailbox, count(*) as n from src group by mailbox)
    select a.mailbox, a.mailbox_ord::integer as mailbox_ord,
        (case when a.mailbox in ({_OPEN}) then coalesce(c.n, 0) else -1 end)::bigint as messages
    from {_ASKED} left join counts c on c.mailbox = a.mailbox""".replace("a.mailbox", "asked.mailbox"),
)
def mailbox_profile_landed(spark, sf_dir):
    """The profile flow over a landed table, read back through the raw source."""
    path = Scratch(spark, "landed").path("raw")
    landed = _src(spark, sf_dir).select("mailbox", "uid", F.lit("x").cast("binary").alias("content"))
    landed.write.partitionBy("mailbox").parquet(path)
    counts, _ = profile.mailbox_profile(spark, path, REQUESTED, readable=READABLE)
    return counts.select("mailbox", "mailbox_ord", "messages")


_PREFIX = """o_orderkey || ' (' || case when o_orderkey % 9 = 8 then '' else 'UID ' || o_orderkey || ' ' end
    || case o_orderkey % 3 when 0 then 'FLAGS (\\\\Seen  $Label' || (o_orderkey % 5) || ') '
        when 1 then 'FLAGS ( ) ' else '' end
    || case when o_orderkey % 2 = 0 then 'X-GM-THRID ' || (o_custkey + 1000) || ' ' else '' end || 'RFC822 {10}'"""


@query(
    "decode_fetch_prefix",
    """select o_orderkey::varchar as uid, case when o_orderkey % 3 = 0 then '\\Seen|$Label' || (o_orderkey % 5) else '' end as flags,
        case when o_orderkey % 2 = 0 then (o_custkey + 1000)::varchar end as provider_thread_id
    from orders where o_orderkey % 9 <> 8""",
)
def decode_fetch_prefix(spark, sf_dir):
    dump = views.table(spark, sf_dir, "orders").selectExpr(f"{_PREFIX} as prefix")
    found = messages.decode_fetch_prefix(dump)
    return found.select("uid", F.array_join("flags", "|").alias("flags"), "provider_thread_id")


@query(
    "mbox_scan",
    f"""with raw as ({views.RAW_SQL})
    select mailbox, 'P' || page_id || '@Mail.example' as message_id, count(*)::bigint as messages, true as whole from raw where v <> 7 group by all""",
)
def mbox_scan(spark, sf_dir):
    """Archives written per mailbox and read in ranges far smaller than they are; contents equal the landed ones."""
    scratch = Scratch(spark, "mbox")
    raw = scratch.write(views.raw_mail(spark, sf_dir).where("content is not null"), "raw")
    scratch.write(mbox.write_archives(raw, scratch.path("archives")), "written")
    scanned = mbox.read_mbox(spark, scratch.path("archives"), partition_bytes=1 << 18)
    ended = F.when(F.expr("right(cast(content as string), 1)") == "\n", F.col("content")).otherwise(F.concat("content", F.lit("\n").cast("binary")))
    landed = raw.select(F.col("mailbox").alias("_box"), F.sha2(ended, 256).alias("_hash")).distinct()
    found = scanned.select(
        "mailbox",
        F.regexp_extract(F.col("content").cast("string"), "Message-ID: <([^>]+)>", 1).alias("message_id"),
        F.sha2("content", 256).alias("hash"),
    )
    joined = found.join(landed, (F.col("mailbox") == F.col("_box")) & (F.col("hash") == F.col("_hash")), "left")
    counted = joined.groupBy("mailbox", "message_id")
    return counted.agg(F.count(F.lit(1)).alias("messages"), F.bool_and(F.col("_hash").isNotNull()).alias("whole"))
