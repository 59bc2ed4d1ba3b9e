"""Message index and reply chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from maillake.operators import reply_chains
from maillake.operators import threads as reference
from maillake.operators.lineage import Scratch
from maillake.operators.root_forest import RootForest

from . import sqltext, views
from .registry import query


def _indexed(spark, sf_dir):
    """mail_src with three rows per message id."""
    src = views.mail_src(spark, sf_dir)
    return src.selectExpr(
        "uid_n", "mailbox", "mailbox_ord", "'d' || (uid_n div 3) || '@mail.example' as message_id", "subject_raw as subject"
    )


@query(
    "message_index",
    f"""with src as ({views.mail_sql('uid_n', 'mailbox', 'mailbox_ord', 'subject_raw')}),
    ranked as (select *, row_number() over (partition by uid_n // 3 order by mailbox_ord desc, uid_n desc) as rn from src)
    select 'd' || (uid_n // 3) || '@mail.example' as message_id, uid_n, mailbox, mailbox_ord::integer as mailbox_ord, subject_raw as subject
    from ranked where rn = 1""",
)
def message_index(spark, sf_dir):
    return reply_chains.message_index(_indexed(spark, sf_dir))


def _links(spark, sf_dir):
    columns = ("uid_n", "mailbox", "mailbox_ord", "message_id", "in_reply_to", "references", "date_ts")
    return views.headers(spark, sf_dir).select(*columns)


EXACT = f"with recursive {sqltext.LINKS}, {sqltext.walk('null', 'null')}"
ANCESTOR = f"with recursive {sqltext.LINKS}, {sqltext.walk('w.cur', 'l.message_id')}"


@query("thread_roots_exact", f"{EXACT} select uid_n, root_message_id from rooted")
def thread_roots_exact(spark, sf_dir):
    return reply_chains.thread_roots(_links(spark, sf_dir), "exact").select("uid_n", "root_message_id")


@query(
    "thread_roots_ancestor",
    f"{ANCESTOR} select uid_n, root_message_id, case when root_message_id is not null then hops else -1 end::bigint as depth from rooted",
)
def thread_roots_ancestor(spark, sf_dir):
    found = reply_chains.thread_roots(_links(spark, sf_dir), "ancestor")
    return found.select("uid_n", "root_message_id", F.coalesce("reply_depth", F.lit(-1)).cast("long").alias("depth"))


@query(
    "thread_sizes",
    f"""{ANCESTOR} select root_message_id, count(*)::bigint as messages, max(hops)::bigint as depth,
        min(sent_ts) as first_sent, max(sent_ts) as last_sent from rooted where root_message_id is not null group by 1""",
)
def thread_sizes(spark, sf_dir):
    return reply_chains.thread_sizes(reply_chains.thread_roots(_links(spark, sf_dir), "ancestor"))


@query(
    "conversation_thread_roots",
    """select conv_id, turn, conv_id || '.0@conv.example' as root_message_id, turn as depth from conversations""",
)
def conversation_thread_roots(spark, sf_dir):
    found = reply_chains.thread_roots(views.conv_mail(spark, sf_dir), "ancestor", ("conv_id", "turn"))
    return found.select("conv_id", "turn", "root_message_id", F.col("reply_depth").cast("long").alias("depth"))


@query(
    "conversation_thread_roots_exact",
    """select conv_id, turn, case when turn >= 3 then conv_id || '.' || (turn - (turn - 3) % 5) || '.ref@conv.example'
        when conv_id % 2 = 0 then conv_id || '.gone@conv.example' end as root_message_id from conversations""",
)
def conversation_thread_roots_exact(spark, sf_dir):
    """Roots are the nearest references, else an unknown parent of the first turn, else nothing."""
    found = reply_chains.thread_roots(views.broken_conv_mail(spark, sf_dir), "exact", ("conv_id", "turn"))
    return found.select("conv_id", "turn", "root_message_id")


@query(
    "thread_roots_deep",
    f"""select o_orderkey as n, (o_orderkey - o_orderkey % {views.DEEP}) || '@deep.example' as root_message_id,
        (o_orderkey % {views.DEEP})::bigint as depth from orders""",
)
def thread_roots_deep(spark, sf_dir):
    found = reply_chains.thread_roots(views.deep_mail(spark, sf_dir), "ancestor", ("n",))
    return found.select("n", "root_message_id", F.col("reply_depth").cast("long").alias("depth"))


# Labels spread along references in both directions until each component has its least id.
REFERENCE_THREADS = f"""with recursive src as ({views.mail_sql('uid_n', 'mailbox_ord', 'sent_ts', 'subject_raw', 'message_id_raw', 'in_reply_to_raw', 'references_raw')}),
links as (
    select uid_n, mailbox_ord, {sqltext.ids('message_id_raw')}[1] as message_id, {sqltext.ids('in_reply_to_raw')}[1] as parent,
        {sqltext.ids('references_raw')} as refs, lower({sqltext.subject('subject_raw')}) as topic, sent_ts from src),
edges as (
    select message_id as a, unnest(list_append(refs, parent)) as b from links),
ways as (
    select a, b from edges where b is not null union select b, a from edges where b is not null),
labels(node, label) using key (node) as (
    select distinct a, a from ways
    union
    select w.b, min(l.label) from labels l join ways w on w.a = l.node join recurring.labels r on r.node = w.b
    where l.label < r.label group by w.b),
members as (
    select l.*, coalesce(c.label, l.message_id) as name, parent is null and len(refs) = 0 as begins
    from links l left join labels c on c.node = l.message_id),
grouped as (
    select name, bool_or(begins) as begun, arg_min(topic, (sent_ts, mailbox_ord, uid_n)) as topic, min(sent_ts)::date as day
    from members group by name),
shared as (
    select topic, day, min(name) as thread_id from grouped where not begun and topic <> '' group by topic, day having count(*) > 1)
select m.uid_n, m.message_id, coalesce(s.thread_id, m.name) as thread_id, s.thread_id is not null as merged
from members m join grouped g using (name) left join shared s on not g.begun and s.topic = g.topic and s.day = g.day"""


@query("reference_threads", REFERENCE_THREADS)
def reference_threads(spark, sf_dir):
    found = reference.reference_threads(views.headers(spark, sf_dir))
    return found.select("uid_n", "message_id", "thread_id", "merged")


@query(
    "thread_roots_after_append",
    f"{ANCESTOR} select uid_n, root_message_id, case when root_message_id is not null then hops else -1 end::bigint as depth from rooted",
)
def thread_roots_after_append(spark, sf_dir):
    """Mails that come in three batches, answers often before what they answer; the same as one full run."""
    links = _links(spark, sf_dir)
    forest = RootForest(spark, Scratch(spark, "forest").root, "ancestor")
    batch = F.col("uid_n") % 7
    for part in (links.where(batch >= 4), links.where(batch == 2), links.where(batch.isin(0, 1, 3))):
        forest.append(part)
    found = forest.message_roots()
    return found.select("uid_n", "root_message_id", F.coalesce("reply_depth", F.lit(-1)).cast("long").alias("depth"))
