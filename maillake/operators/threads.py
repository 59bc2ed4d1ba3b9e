"""Threads by all references, and by subject and day where the beginning of a thread is missing.

Every message is linked to the message it answers and to all messages it refers to; a thread is what these links connect.
A group of messages without a beginning (each of them answers something, or has neither an id nor a reference) may be one
part of a thread whose links are lost: such groups become one thread if their first messages have the same canonical
subject and the same day.

Connected components are joins and minima over narrow rows. Nothing gathers a component: a message that a fifth of all
mails refer to is a key whose rows are combined before the shuffle, and spread over many tasks where they look it up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_bucket
from . import skew
from .lineage import Scratch

MOST_ROUNDS = 100  # rounds and jumps halve what is left; passing this is an error, never a cut result
# Ids carry no white space around them, so no id looks like the key of a message without one.
NO_ID = " row:"


def _spread_lookup(left: DataFrame, right: DataFrame, key: str, right_key: str, by: list[str], heavy_rows: int, how: str) -> DataFrame:
    """``left`` has to be a stored table."""
    return skew.lookup(left, right, key, right_key, by, skew.heavy_keys_stored(left, key, heavy_rows), how)


def components(edges: DataFrame, scratch: Scratch, name: str = "components", heavy_rows: int = skew.HEAVY_ROWS) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for all nodes of the edges ``a``, ``b``.

    In a round every node takes the smallest of itself and its neighbours as label. Labels follow their own labels, twice as
    far each time, to the end, so a long chain in any order is one label; then the edges are redrawn between labels. Edges inside
    one label go, so later rounds are ever smaller. Rounds are written tables, so a lost executor costs no earlier one; all but
    the result are removed in the end.
    """
    written: list[str] = []

    def put(df: DataFrame, table: str) -> DataFrame:
        written.append(f"{name}-{table}")
        return scratch.write(df, written[-1])

    pairs = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = put(pairs.distinct(), "edges-0")
    moves: list[tuple[DataFrame, str]] = []
    for round_ in range(MOST_ROUNDS):
        if left.isEmpty():
            break
        ends = left.union(left.select(F.col("b"), F.col("a"))).toDF("node", "other")
        near = ends.groupBy("node").agg(F.min("other").alias("label"))
        near = near.select("node", F.least("node", "label").alias("label"), (F.col("node") <= F.col("label")).alias("settled"))
        labels = _followed(near, put, f"labels-{round_}", heavy_rows)
        moves.append((labels, written[-1]))
        for end in ("a", "b"):
            target = labels.toDF("_at", "_next")
            left = _spread_lookup(left, target, end, "_at", ["a", "b"], heavy_rows, "inner")
            left = left.withColumn(end, F.col("_next")).drop("_next")
            if end == "a":
                left = put(left, f"half-{round_}")
        left = left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left = put(left, f"edges-{round_ + 1}")
    else:
        raise RuntimeError("components did not settle")
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))  # empty
    # Labels of the last round are final; earlier ones move on by the later rounds.
    final, kept = moves[-1]
    for round_ in reversed(range(len(moves) - 1)):
        target = final.toDF("_at", "_next")
        moved = _spread_lookup(moves[round_][0], target, "label", "_at", ["node"], heavy_rows, "left")
        final = put(moved.select("node", F.coalesce("_next", "label").alias("label")), f"final-{round_}")
        kept = written[-1]
    scratch.drop(*[table for table in written if table != kept])
    return final.withColumnRenamed("label", "component")


def _followed(near: DataFrame, put: Callable[[DataFrame, str], DataFrame], name: str, heavy_rows: int) -> DataFrame:
    """Labels followed to their ends: no label is above its node, so there are no cycles.

    A node is ``settled`` once its label is known to be an end; only the others are looked up again. After jump j all nodes
    less than 2 ** j labels away from their end are settled, so no jump is made only to see that nothing moves.
    """
    labels = put(near, f"{name}-0")
    for jump in range(1, MOST_ROUNDS):
        left = labels.where("not settled")
        if left.isEmpty():
            return labels.select("node", "label")
        moved = _spread_lookup(left, labels.toDF("_at", "_next", "_settled"), "label", "_at", ["node"], heavy_rows, "inner")
        moved = moved.select("node", F.col("_next").alias("label"), F.col("_settled").alias("settled"))
        labels = put(labels.where("settled").union(moved), f"{name}-{jump}")
    raise RuntimeError("labels did not settle")


def _links(headers: DataFrame, order: tuple[str, ...], subject: str, sent: str) -> DataFrame:
    """Narrow rows: the message's node, all ids it refers to, and what a merge by subject needs."""
    row = F.concat(F.lit(NO_ID), F.to_json(F.struct(*order)))
    none = F.array().cast("array<string>")
    refs = F.concat(F.coalesce(F.col("references"), none), F.array("in_reply_to"))
    return headers.select(
        *order,
        "message_id",
        F.coalesce("message_id", row).alias("node"),
        F.array_distinct(F.array_compact(refs)).alias("refs"),
        F.lower(F.coalesce(subject, F.lit(""))).alias("topic"),
        F.coalesce(F.col(sent).cast("string"), F.lit("")).alias("sent"),
    )


def reference_threads(
    headers: DataFrame,
    order: tuple[str, ...] = ("mailbox_ord", "uid_n"),
    subject: str = "subject_canonical",
    sent: str = "date_utc",
    heavy_rows: int = skew.HEAVY_ROWS,
) -> DataFrame:
    """``order``, ``message_id``, ``thread_id`` and ``merged`` (by subject and day) for each message.

    ``thread_id`` is the smallest id of the thread, its messages' or one they refer to; a thread without any id has a key
    made of ``order`` of one of its messages. ``order`` must identify a row. ``sent`` is UTC text; the first
    message of a group is the one sent first (without a date: last), then the first in ``order``. Messages without a subject
    are never merged by it. Several messages with one id are in one thread. An empty table gives an empty one.
    """
    scratch = Scratch(headers.sparkSession, "threads")
    links = scratch.write(_links(headers, order, subject, sent), "links")
    edges = links.select(F.col("node").alias("a"), F.explode("refs").alias("b"))
    found = components(edges, scratch, heavy_rows=heavy_rows)
    member = _spread_lookup(links, found.toDF("_node", "component"), "node", "_node", list(order), heavy_rows, "left")
    member = scratch.write(
        member.select(
            *order,
            "message_id",
            F.coalesce("component", "node").alias("component"),
            (F.col("message_id").isNotNull() & (F.size("refs") == 0)).alias("begins"),
            "topic",
            "sent",
        ),
        "members",
    )
    first = F.min(F.struct(F.col("sent") == "", "sent", *order, "topic")).alias("first")
    groups = member.groupBy("component").agg(F.max("begins").alias("begun"), first, F.count(F.lit(1)).alias("rows"))
    # Referred ids count for the name, whether their messages are there or not. Any other component is named by its least id already.
    unnamed = F.col("component").startswith(NO_ID) & ~F.col("node").startswith(NO_ID)
    least = found.where(unnamed).groupBy("component").agg(F.min("node").alias("name"))
    named = groups.join(least.withColumnRenamed("component", "_of"), F.col("component") == F.col("_of"), "left")
    named = scratch.write(
        named.select(
            "component",
            "rows",
            F.coalesce("name", "component").alias("name"),
            F.when(~F.col("begun") & (F.col("first.topic") != ""), _topic_key(F.col("first.topic"), F.col("first.sent"))).alias("key"),
        ),
        "groups",
    )
    no_id = F.col("name").startswith(NO_ID)
    shared = named.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min(F.struct(no_id, "name")).alias("least"), F.count(F.lit(1)).alias("groups")
    )
    shared = shared.where(F.col("groups") > 1).select(F.col("key").alias("_key"), F.col("least.name").alias("_name"))
    joined = skew.lookup_measured(named, scratch.write(shared, "shared"), "key", "_key", ["component"])
    threads = scratch.write(
        joined.select(F.col("component").alias("_of"), F.coalesce("_name", "name").alias("thread_id"), F.col("_name").isNotNull().alias("merged")),
        "threads",
    )
    often = skew.heavy_counts(named, "component", "rows", heavy_rows)
    out = skew.lookup(member, threads, "component", "_of", list(order), often, "left")
    return out.select(*order, "message_id", "thread_id", "merged")


def _topic_key(topic: Column, sent: Column) -> Column:
    return F.concat(day_bucket(F.when(sent != "", sent)), F.lit(":"), topic)
