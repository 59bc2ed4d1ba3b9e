"""Thread roots of a corpus that grows: a stored forest of reply pointers to which batches of messages are added.

Three narrow tables lie under one folder, each written in versions, one per batch:

* ``links``: a row per message, its id, what it answers and its first reference;
* ``index``: the last message of each id, where the batch changed it;
* ``roots``: the root of each answered id, where the batch changed it.

A batch changes the walks that lead through an id which it brings or redefines. All of these ended at the same root as that
id did before, so only ids with such a root, and ids answered for the first time, are walked again; walks that meet
any other id take over its stored root. Nothing else is written, and the messages themselves are never read again.

A version counts once its mark is written, after its tables: a batch that fails half-way leaves nothing that is
read. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import skew
from .lineage import Scratch
from .reply_chains import MODES, first_steps, message_index, settle, with_roots


class RootForest:
    """The forest under ``folder``. ``order`` identifies a message; of equal ids the last one in it counts."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        mode: str = "ancestor",
        order: tuple[str, ...] = ("mailbox_ord", "uid_n"),
        heavy_rows: int = skew.HEAVY_ROWS,
    ) -> None:
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        self.spark, self.folder, self.mode, self.order, self.heavy_rows = spark, folder, mode, order, heavy_rows

    # -- versions -----------------------------------------------------------------------------------

    MARKS = T.StructType().add("version", T.LongType()).add("stamp", T.StringType()).add("compacted", T.BooleanType())

    def versions(self) -> list[tuple[int, str]]:
        """Version and folder name of each batch that counts, from the last compaction on."""
        marks = self._marks()
        first = max((m["version"] for m in marks if m["compacted"]), default=0)
        return sorted((m["version"], m["stamp"]) for m in marks if m["version"] >= first)

    def _marks(self) -> list:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(self.MARKS).parquet(f"{self.folder}/marks").collect()  # a row per batch
        except AnalysisException:  # no batch yet
            return []

    def _mark(self, version: int, stamp: str, compacted: bool) -> None:
        row = self.spark.createDataFrame([(version, stamp, compacted)], self.MARKS)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/marks")

    def _read(self, name: str, versions: list[tuple[int, str]]) -> DataFrame | None:
        parts = [
            self.spark.read.parquet(f"{self.folder}/{name}-{stamp}").withColumn("version", F.lit(version))
            for version, stamp in versions
        ]
        whole = None
        for part in parts:
            whole = part if whole is None else whole.unionByName(part)
        return whole

    def _latest(self, name: str, key: str, versions: list[tuple[int, str]]) -> DataFrame | None:
        """The newest row of each key."""
        rows = self._read(name, versions)
        if rows is None or len(versions) == 1:
            return None if rows is None else rows.drop("version")
        rest = [c for c in rows.columns if c not in (key, "version")]
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("_row"))
        return newest.select(key, "_row.*")

    # -- batches ------------------------------------------------------------------------------------

    def append(self, headers: DataFrame) -> None:
        """Add new messages. Ids of the batch may have been answered before, or have been there before."""
        versions = self.versions()
        version, stamp = (versions[-1][0] + 1 if versions else 0), uuid.uuid4().hex
        scratch = Scratch(self.spark, "root-forest")
        links = self._store(
            headers.select(
                *self.order, "message_id", F.col("in_reply_to").alias("parent"), F.get("references", F.lit(0)).alias("first_ref")
            ),
            "links",
            stamp,
        )
        changed = self._change_index(links, versions, stamp, scratch)
        index = self._latest("index", "message_id", [*versions, (version, stamp)])
        answered = links.where(F.col("first_ref").isNull() & F.col("parent").isNotNull()).select(F.col("parent").alias("id")).distinct()
        old = self._latest("roots", "id", versions)
        if old is None:
            start = first_steps(answered, index, self.mode)
        else:
            todo = scratch.write(self._to_walk(answered, changed, old), "todo")
            start = self._resume(first_steps(todo, index, self.mode), old.join(todo, "id", "left_anti"))
        settled = settle(start, scratch, self.heavy_rows).state()
        self._store(settled.select("id", "root", "hops"), "roots", stamp)
        self._mark(version, stamp, compacted=False)

    def _store(self, df: DataFrame, name: str, stamp: str) -> DataFrame:
        path = f"{self.folder}/{name}-{stamp}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _change_index(self, links: DataFrame, versions: list[tuple[int, str]], stamp: str, scratch: Scratch) -> DataFrame:
        """Store the index rows that the batch changes; returns the ids that now lead elsewhere."""
        place = F.struct(*self.order)
        new = message_index(links, self.order).select("message_id", "parent", "first_ref", place.alias("place"))
        before = self._latest("index", "message_id", versions)
        if before is None:
            stored = self._store(new, "index", stamp)
            return stored.select(F.col("message_id").alias("id"))
        names = [F.col("message_id").alias("_id"), F.col("parent").alias("_parent"), F.col("first_ref").alias("_first"), F.col("place").alias("_place")]
        both = new.join(before.select(*names), F.col("message_id") == F.col("_id"), "left")
        both = both.where(F.col("_id").isNull() | (F.col("place") > F.col("_place")))
        moved = F.col("_id").isNull() | ~(F.col("parent").eqNullSafe(F.col("_parent")) & F.col("first_ref").eqNullSafe(F.col("_first")))
        rows = scratch.write(both.select("message_id", "parent", "first_ref", "place", moved.alias("moved")), "changed-index")
        self._store(rows.drop("moved"), "index", stamp)
        return rows.where("moved").select(F.col("message_id").alias("id"))

    def _to_walk(self, answered: DataFrame, changed: DataFrame, old: DataFrame) -> DataFrame:
        """Ids answered for the first time, and those whose root is that of a changed id."""
        touched = old.join(changed, "id", "left_semi").select(F.col("root").alias("_root")).distinct()
        same = F.col("root").eqNullSafe(F.col("_root"))
        # The list of touched roots is distinct; rows of one root are many, so they stay where they are if it is small.
        small = skew.measured_bytes(touched) <= skew.BROADCAST_BYTES
        stale = old.join(F.broadcast(touched) if small else touched, same, "left_semi").select("id")
        return answered.join(old, "id", "left_anti").union(stale)

    def _resume(self, start: DataFrame, kept: DataFrame) -> DataFrame:
        """Open walks that have come to an id with a stored root end there."""
        known = kept.select(F.col("id").alias("_id"), F.col("root").alias("_root"), F.col("hops").alias("_hops"))
        met = F.col("_id").isNotNull()
        joined = start.join(known, F.col("ptr") == F.col("_id"), "left")
        return joined.select(
            "id",
            F.when(~met, F.col("ptr")).alias("ptr"),
            F.when(met, F.col("hops") + F.col("_hops")).otherwise(F.col("hops")).alias("hops"),
            (F.col("done") | met).alias("done"),
            F.when(met, F.col("_root")).otherwise(F.col("root")).alias("root"),
        )

    # -- results ------------------------------------------------------------------------------------

    def roots(self) -> DataFrame:
        """``id``, ``root`` and ``hops`` of every answered id."""
        found = self._latest("roots", "id", self.versions())
        schema = T.StructType().add("id", T.StringType()).add("root", T.StringType()).add("hops", T.IntegerType())
        return self.spark.createDataFrame([], schema) if found is None else found

    def message_roots(self) -> DataFrame:
        """``order``, ``message_id``, ``root_message_id`` and ``reply_depth`` of all messages, from the narrow tables."""
        versions = self.versions()
        if not versions:
            raise ValueError("the forest holds no batch")
        links = self._read("links", versions).drop("version")
        walk = F.when(F.col("first_ref").isNull(), F.col("parent"))
        known = self.roots().select(F.col("id").alias("_id"), F.col("root").alias("_root"), F.col("hops").alias("_hops"))
        joined = skew.lookup(
            links.withColumn("_walk", walk), known, "_walk", "_id", list(self.order),
            skew.heavy_keys(links.where("first_ref is null"), "parent", self.heavy_rows),
        )
        out = with_roots(joined, F.col("_walk"), F.col("first_ref"), self.mode)
        return out.select(*self.order, "message_id", "root_message_id", "reply_depth")

    def compact(self) -> None:
        """Write all versions as one; older ones are no longer read."""
        versions = self.versions()
        if len(versions) < 2:
            return
        stamp = uuid.uuid4().hex
        self._store(self._read("links", versions).drop("version"), "links", stamp)
        self._store(self._latest("index", "message_id", versions), "index", stamp)
        self._store(self._latest("roots", "id", versions), "roots", stamp)
        self._mark(versions[-1][0] + 1, stamp, compacted=True)
