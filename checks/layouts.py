"""Joins of tables that are laid out for them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from maillake.operators import enrich, layout, reply_chains
from maillake.operators.lineage import Scratch

from . import mime, sqltext, views
from .registry import query

BUCKETS = 8
KEYS = ["mailbox", "uid"]


def _bucketed(spark, df, name, keys):
    """A bucketed table under the shared folder, with a name of its own."""
    scratch, name = Scratch(spark, "layout"), f"{name}_{uuid.uuid4().hex}"
    return layout.write_bucketed(df, name, scratch.path(name), keys, BUCKETS)


def joined_headers(spark, sf_dir):
    full, headers, known = (_bucketed(spark, part, "mail", KEYS) for part in mime.header_parts(spark, sf_dir))
    return enrich.with_known_conversation(enrich.with_headers(full, headers), known)


@query("header_join_bucketed", mime.HEADER_JOIN)
def header_join_bucketed(spark, sf_dir):
    """The joins of header_full_join, without any shuffle after the tables are written."""
    return joined_headers(spark, sf_dir).select("uid_n", "subject", "conversation_id")


def parent_tables(spark, sf_dir, heavy_rows=200):
    """Narrow mails split by what they answer, and the index of all ids in buckets."""
    scratch = Scratch(spark, "layout")
    mail = scratch.write(views.headers(spark, sf_dir).select("uid_n", "mailbox_ord", "message_id", "in_reply_to", "subject"), "mail")
    index = reply_chains.message_index(mail.select("uid_n", "mailbox_ord", "message_id", "subject"))
    index = index.select("message_id", F.col("subject").alias("parent_subject"))
    indexed = _bucketed(spark, index.withColumnRenamed("message_id", "parent_id"), "ids", ["parent_id"])
    name = f"answers_{uuid.uuid4().hex}"
    left = mail.select("uid_n", "in_reply_to")
    return layout.write_split(left, name, scratch.root, "in_reply_to", BUCKETS, heavy_rows, share=0.0), indexed


@query(
    "parent_subjects_bucketed",
    f"""with src as ({views.mail_sql('uid_n', 'mailbox_ord', 'message_id_raw', 'in_reply_to_raw', 'subject_raw')}),
    links as (select uid_n, subject_raw, {sqltext.ids('message_id_raw')}[1] as message_id, {sqltext.ids('in_reply_to_raw')}[1] as parent from src)
    select l.uid_n, p.message_id as parent_id, p.subject_raw as parent_subject from links l left join links p on p.message_id = l.parent""",
)
def parent_subjects_bucketed(spark, sf_dir):
    """What each mail answers; one mail that many answer is looked up apart."""
    left, index = parent_tables(spark, sf_dir)
    return layout.lookup_split(left, index, "parent_id").select("uid_n", "parent_id", "parent_subject")
