"""Roll-ups merged from stored sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from maillake.operators import people, rollups
from maillake.operators.lineage import Scratch

from . import addresses, views
from .registry import query

MOST_OFF = 0.03  # of the distinct count, and of the rank of a quantile


def _mail(spark, sf_dir):
    mail = people.with_participants(views.headers(spark, sf_dir))
    month, day = F.date_format("date_ts", "yyyy-MM"), F.to_date("date_ts")
    return mail.select("mailbox", month.alias("month"), day.alias("day"), F.length("subject").alias("size"), "participants", "date_ts")


@query(
    "monthly_rollup",
    f"""with src as ({addresses.SRC}), mail as (
        select mailbox, strftime(sent_ts, '%Y-%m') as month, length(subject_raw) as size, {addresses.PARTICIPANTS} as people, sent_ts from src),
    met as (select mailbox, month, count(distinct person)::bigint as people from (select mailbox, month, unnest(people) as person from mail) group by all)
    select m.mailbox, m.month, count(*)::bigint as messages, sum(size)::bigint as bytes, min(sent_ts) as first_sent, max(sent_ts) as last_sent,
        coalesce(any_value(met.people), 0) as people, true as people_close, true as median_close
    from mail m left join met using (mailbox, month) group by m.mailbox, m.month""",
)
def monthly_rollup(spark, sf_dir):
    """Days are rolled up in two batches and stored; months come from the stored rows. Exact values beside the estimates."""
    scratch = Scratch(spark, "rollups")
    mail = scratch.write(_mail(spark, sf_dir), "mail")
    by = ["mailbox", "day"]
    odd = F.pmod(F.xxhash64("date_ts", "size"), F.lit(2)) == 1
    stored = scratch.write(rollups.roll_up(mail.where(odd), by), "batch-0").unionByName(scratch.write(rollups.roll_up(mail.where(~odd), by), "batch-1"))
    months = rollups.merge(stored.withColumn("month", F.date_format("day", "yyyy-MM")), ["mailbox", "month"])
    told = months.select("*", rollups.people().alias("about"), rollups.size_quantile(0.5).alias("median"))
    person = mail.select("mailbox", "month", F.explode("participants").alias("person"))
    exact = person.groupBy("mailbox", "month").agg(F.countDistinct("person").alias("people"))
    beside = mail.join(told.select("mailbox", "month", "median"), ["mailbox", "month"]).groupBy("mailbox", "month")
    ranks = beside.agg(F.avg((F.col("size") < F.col("median")).cast("double")).alias("below"), F.avg((F.col("size") <= F.col("median")).cast("double")).alias("upto"))
    joined = told.join(exact, ["mailbox", "month"], "left").join(ranks, ["mailbox", "month"])
    near = F.abs(F.col("about") - F.coalesce("people", F.lit(0))) <= F.greatest(F.lit(1.0), MOST_OFF * F.coalesce("people", F.lit(0)))
    return joined.select(
        "mailbox", "month", "messages", "bytes", "first_sent", "last_sent",
        F.coalesce("people", F.lit(0)).cast("long").alias("people"),
        near.alias("people_close"),
        ((F.col("below") <= 0.5 + MOST_OFF) & (F.col("upto") >= 0.5 - MOST_OFF)).alias("median_close"),
    )
