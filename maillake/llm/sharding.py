"""Sharding by fixed virtual slots.

A record's key hashes to one of ``SLOTS`` slots for good. Bytes are summed per slot, and a versioned table
maps slots to shards: the first version deals the slots round, ``rebalance`` edits a version so that the
shards' bytes come near equal, ``grow`` edits it so that a new shard takes whole slots from the others, and
records between old shards never move. Only per-slot numbers (at most ``SLOTS`` rows) reach the driver.

Defined results: a null text counts its frame only; a null key hashes by the text, so keyless rows spread;
repeated rows share a slot; an empty table has a map and no rows; columns of the input are kept, columns
added (``shard``, ``virtual_slot``) replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOTS = 8192
FRAME_BYTES = 8  # per record, besides its text


def byte_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + FRAME_BYTES).cast("long")


def slot_of(key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> Column:
    """The virtual slot of a record, by its key alone; records without a key go by their text."""
    by_key = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\0"), F.coalesce(F.col(text), F.lit(""))))
    return F.pmod(F.xxhash64(by_key), F.lit(slots)).cast("int")


def slot_loads(sized: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows per slot of a table with ``virtual_slot`` and ``size``: at most ``slots`` rows are collected."""
    rows = sized.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    loads, counts = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for slot, size, n in rows:
        loads[slot], counts[slot] = size, n
    return loads, counts


def dealt(shards: int, slots: int = SLOTS) -> np.ndarray:
    """Version 0 of a map: slots dealt round, whatever they hold."""
    return np.arange(slots, dtype=np.int32) % shards


def rebalance(owner: Sequence[int], loads: np.ndarray, shards: int) -> np.ndarray:
    """A new version of the map whose shards hold nearly the same bytes.

    Slots move from the fullest shard to the emptiest, each time the slot nearest to half of the difference,
    as long as that lowers the fullest; slots exchanged last close what single moves leave. Few slots move
    when the map was nearly even. Slots without bytes stay.
    """
    owner = np.array(owner, dtype=np.int32)
    held = np.bincount(owner, weights=loads, minlength=shards).astype(np.int64)
    members = [list(np.flatnonzero((owner == s) & (loads > 0))) for s in range(shards)]

    def move(slot: int, high: int, low: int) -> None:
        owner[slot] = low
        members[high].remove(slot)
        members[low].append(slot)
        held[high] -= loads[slot]
        held[low] += loads[slot]

    for _ in range(4 * len(owner)):
        high, low = int(held.argmax()), int(held.argmin())
        gap = int(held[high] - held[low])
        own = np.array(members[high], dtype=np.int64)
        if not len(own):
            break
        best = int(own[np.abs(2 * loads[own] - gap).argmin()])
        if 0 < loads[best] < gap:
            move(best, high, low)
            continue
        other = np.array(members[low], dtype=np.int64)
        if not len(other):
            break
        order = other[np.argsort(loads[other], kind="stable")]
        wanted = loads[own] - gap / 2
        at = np.clip(np.searchsorted(loads[order], wanted), 0, len(order) - 1)
        change = loads[own] - loads[order[at]]
        gain = np.where((change > 0) & (change < gap), np.minimum(change, gap - change), 0)
        if gain.max() <= 0:
            break
        k = int(gain.argmax())
        give, take = int(own[k]), int(order[at[k]])
        move(give, high, low)
        move(take, low, high)
    return owner


def grow(owner: Sequence[int], loads: np.ndarray, shards: int) -> np.ndarray:
    """A new version with one more shard (number ``shards``): it takes whole slots, from the fullest first."""
    owner = np.array(owner, dtype=np.int32)
    held = np.bincount(owner, weights=loads, minlength=shards + 1).astype(np.int64)
    goal = int(loads.sum()) // (shards + 1)
    members = [sorted(np.flatnonzero(owner == s), key=lambda slot: (loads[slot], slot)) for s in range(shards)]
    while held[shards] < goal:
        high = int(held[:shards].argmax())
        fitting = [slot for slot in members[high] if 0 < loads[slot] <= goal - held[shards]]
        if not fitting:
            break
        slot = fitting[-1]
        members[high].remove(slot)
        owner[slot] = shards
        held[high] -= loads[slot]
        held[shards] += loads[slot]
    return owner


def map_frame(spark: SparkSession, owner: Sequence[int], version: int) -> DataFrame:
    rows = [(version, slot, int(shard)) for slot, shard in enumerate(owner)]
    return spark.createDataFrame(rows, "version int, virtual_slot int, shard int")


def save_map(spark: SparkSession, folder: str, owner: Sequence[int], version: int) -> None:
    """Add a version to the stored map; a version once written never changes."""
    map_frame(spark, owner, version).coalesce(1).write.parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """A stored version: one row per slot."""
    return spark.read.parquet(f"{folder}/version={version}").select("virtual_slot", "shard")


def assign(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records with ``virtual_slot`` get their ``shard``; the map has one row per slot, so it is broadcast."""
    return records.drop("shard").join(F.broadcast(slot_map), "virtual_slot")


def place(assigned: DataFrame, starts: DataFrame, order: Sequence[str]) -> DataFrame:
    """The records' places in their shard, ``slot``, gapless from 0.

    The virtual slots of a shard follow each other, so only records of one virtual slot are ranked together.
    """
    rank = F.row_number().over(W.partitionBy("virtual_slot").orderBy(*order)) - 1
    placed = assigned.withColumn("_rank", rank).join(F.broadcast(starts), "virtual_slot")
    return placed.withColumn("slot", (F.col("_rank") + F.col("_start")).cast("long")).drop("_rank", "_start")


def starts_frame(spark: SparkSession, owner: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Where each virtual slot begins in its shard."""
    rows = []
    after: dict[int, int] = {}
    for slot, (shard, n) in enumerate(zip(owner.tolist(), counts.tolist())):
        rows.append((slot, after.get(shard, 0)))
        after[shard] = after.get(shard, 0) + n
    return spark.createDataFrame(rows, "virtual_slot int, _start long")
