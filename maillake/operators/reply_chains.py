"""Thread roots by reply chain.

A walk from parent to parent becomes pointer doubling: each round every open message id jumps to where
its target had got to, so a chain of length n closes in about log2(n) rounds of self-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import skew
from .lineage import Rounds, Scratch

MODES = ("exact", "ancestor")


def message_index(headers: DataFrame, order: tuple[str, ...] = ("mailbox_ord", "uid_n")) -> DataFrame:
    """One row per message id: the last one in ``order`` wins. Rows without an id are left out."""
    rest = [c for c in headers.columns if c != "message_id"]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    known = headers.where(F.col("message_id").isNotNull())
    return known.groupBy("message_id").agg(last).select("message_id", "_last.*")


def _jump(opened: DataFrame, state: DataFrame, heavy: list) -> DataFrame:
    """One jump for every open id: it takes over where its target is."""
    target = state.select(*[F.col(c).alias(f"_{c}") for c in ("id", "ptr", "hops", "done", "root")])
    joined = skew.lookup(opened, target, "ptr", "_id", ["id"], heavy, "inner")
    return joined.select(
        "id",
        F.col("_ptr").alias("ptr"),
        (F.col("hops") + F.col("_hops")).alias("hops"),
        F.col("_done").alias("done"),
        F.col("_root").alias("root"),
    )


def first_steps(ids: DataFrame, index: DataFrame, mode: str) -> DataFrame:
    """Where the walk of each ``id`` stands after its first step: at its parent, or at its root if that is known.

    ``index`` has one row per ``message_id`` with ``parent`` and ``first_ref``.
    """
    known = index.select("message_id", F.col("parent").alias("ptr"), "first_ref")
    nodes = ids.join(known, F.col("id") == F.col("message_id"), "left")
    outside = F.col("message_id").isNull()
    closed = outside | F.col("first_ref").isNotNull() | F.col("ptr").isNull()
    top = F.col("message_id") if mode == "ancestor" else F.lit(None).cast("string")
    return nodes.select(
        "id",
        F.when(~closed, F.col("ptr")).alias("ptr"),
        F.when(closed, F.lit(0)).otherwise(F.lit(1)).alias("hops"),
        closed.alias("done"),
        F.when(outside, F.col("id")).when(closed, F.coalesce("first_ref", top)).alias("root"),
    )


def settle(start: DataFrame, scratch: Scratch, heavy_rows: int = skew.HEAVY_ROWS) -> Rounds:
    """Jump until every walk is at its end; ids left open are in a cycle. Every open ``ptr`` is an ``id`` of ``start``."""
    rounds = Rounds(scratch, "rounds")
    rounds.add(start)
    remaining, before = rounds.open().count(), None
    # Distances to a settled id have no gaps, so a round that settles nothing leaves only cycles.
    while remaining and remaining != before:
        opened = rounds.open()
        often = skew.heavy_keys(opened, "ptr", heavy_rows, total=remaining)
        rounds.add(_jump(opened, rounds.state(), often))
        remaining, before = rounds.open().count(), remaining
    return rounds


def with_roots(rows: DataFrame, walk: Column, first_ref: Column, mode: str) -> DataFrame:
    """``root_message_id`` and ``reply_depth`` of rows that have been joined with ``_root`` and ``_hops`` of their ``walk``."""
    own = F.col("message_id") if mode == "ancestor" else F.lit(None).cast("string")
    root = F.when(first_ref.isNotNull(), first_ref).when(walk.isNull(), own).otherwise(F.col("_root"))
    depth = F.when(walk.isNull(), F.lit(0)).otherwise(F.col("_hops") + 1)
    rooted = rows.withColumn("root_message_id", root)
    return rooted.withColumn("reply_depth", F.when(F.col("root_message_id").isNotNull(), depth))


def thread_roots(
    headers: DataFrame,
    mode: str = "ancestor",
    order: tuple[str, ...] = ("mailbox_ord", "uid_n"),
    heavy_rows: int = skew.HEAVY_ROWS,
) -> DataFrame:
    """Add ``root_message_id`` and ``reply_depth`` to a header table.

    The root is the first reference; else the end of the in-reply-to walk: a parent's first reference or
    an id that is not in the corpus. A walk ending at a known message without headers gives null in mode
    ``exact`` and that message's id in mode ``ancestor``, where a message without headers is its own root.
    Cycles give null. ``order`` must identify a row; it decides which of several rows with one id is the parent.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    scratch = Scratch(headers.sparkSession, "reply-chains")
    # The narrow link table is written once: every later step but the last join reads only it.
    links = scratch.write(
        headers.select(
            *order, "message_id", F.col("in_reply_to").alias("parent"), F.get("references", F.lit(0)).alias("first_ref")
        ),
        "links",
    )
    # Only ids that somebody replies to can lie on a walk. Everyone else is resolved by the last join.
    replied = links.where(F.col("first_ref").isNull() & F.col("parent").isNotNull()).select(F.col("parent").alias("id"))
    start = first_steps(replied.distinct(), message_index(links, order), mode)
    rounds = settle(start, scratch, heavy_rows)
    # Ids left open have a null root.
    roots = rounds.state()
    known = roots.select(F.col("id").alias("_id"), F.col("root").alias("_root"), F.col("hops").alias("_hops"))
    first_ref = F.get("references", F.lit(0))
    walkers = headers.withColumn("_walk", F.when(first_ref.isNull(), F.col("in_reply_to")))
    # The rows are whole headers: they stay where they are unless there are too many roots to send to every task.
    if skew.measured_bytes(known) <= skew.BROADCAST_BYTES:
        joined = walkers.join(F.broadcast(known), F.col("_walk") == F.col("_id"), "left").drop("_id")
    else:
        often = skew.heavy_keys(links.where("first_ref is null"), "parent", heavy_rows)
        joined = skew.lookup(walkers, known, "_walk", "_id", list(order), often)
    return with_roots(joined, F.col("_walk"), first_ref, mode).drop("_walk", "_root", "_hops")


def thread_sizes(rooted: DataFrame, sent: str = "date_ts") -> DataFrame:
    """Messages, depth and span of each thread."""
    return (
        rooted.where(F.col("root_message_id").isNotNull())
        .groupBy("root_message_id")
        .agg(
            F.count(F.lit(1)).alias("messages"),
            F.max("reply_depth").cast("long").alias("depth"),
            F.min(sent).alias("first_sent"),
            F.max(sent).alias("last_sent"),
        )
    )
