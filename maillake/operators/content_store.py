"""A content store that grows: batches of attachments are added, and bytes that are there already never move.

Under one folder lie

* ``contents/prefix=<hex>``: each distinct content once, by the first digits of its hash;
* ``filter``: a Bloom filter of the stored hashes, as rows (word, bits), one set of rows per batch;
* ``marks``: a row per batch, written last; only batches with a mark are read.

A batch's distinct hashes are tested against the filter. What the filter does not know is new. What it may know is compared
exactly, in the folders of those hashes only. Then the first copy of each new content is written. The filter is
sized by the measured number of contents, and rebuilt from the narrow hash column once the store outgrows it.
"""

from __future__ import annotations

import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import skew
from .attachments import first_copies
from .lineage import Scratch

HASHES = 5
BITS_PER_CONTENT = 10  # about one in a hundred unknown contents is compared exactly
LEAST_CONTENTS = 1 << 16
PREFIX_DIGITS = 3
FILE_BYTES = 1 << 30
MARKS = (
    T.StructType().add("batch", T.LongType()).add("stamp", T.StringType()).add("contents", T.LongType())
    .add("words", T.LongType()).add("filter", T.StringType())
)


def bit_places(sha256: Column, words: int) -> list[Column]:
    """Word and bit mask of each hash function: slices of the content's own hash."""
    out = []
    for k in range(HASHES):
        number = F.conv(F.substring(sha256, 1 + 12 * k, 12), 16, 10).cast("long")
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(64)).cast("int"))
        out.append(F.struct(F.pmod(F.floor(number / 64), F.lit(words)).cast("long").alias("word"), mask.alias("mask")))
    return out


def filter_bits(hashes: DataFrame, words: int) -> DataFrame:
    """Bloom filter of the column ``sha256`` as rows (word, bits), built by a combined aggregation."""
    places = hashes.select(F.inline(F.array(*bit_places(F.col("sha256"), words))))
    return places.groupBy("word").agg(F.bit_or("mask").alias("bits"))


def possible(hashes: DataFrame, bits: DataFrame, words: int) -> DataFrame:
    """The hashes that the filter may know. ``bits`` may have several rows per word; ``hashes`` are distinct."""
    asked = hashes.select("sha256", F.inline(F.array(*bit_places(F.col("sha256"), words))))
    whole = bits.groupBy("word").agg(F.bit_or("bits").alias("bits")).withColumnRenamed("word", "_word")
    met = asked.join(whole, F.col("word") == F.col("_word")).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    # All functions must be met; two that fall on one place are two rows.
    return met.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == HASHES).select("sha256")


class ContentStore:
    """The store under ``folder``. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, least_contents: int = LEAST_CONTENTS) -> None:
        self.spark, self.folder, self.least_contents = spark, folder, least_contents

    def _marks(self) -> list:
        try:
            return sorted(self.spark.read.schema(MARKS).parquet(f"{self.folder}/marks").collect())  # a row per batch
        except AnalysisException:  # nothing stored yet
            return []

    SCHEMA = "sha256 string, size long, payload binary, stamp string, prefix string"  # with the folders, as text

    def _read(self, marks: list) -> DataFrame:
        folders = [f"{self.folder}/contents/stamp={m['stamp']}" for m in marks if m["contents"]]
        return self.spark.read.schema(self.SCHEMA).option("basePath", f"{self.folder}/contents").parquet(*folders)

    def history(self) -> DataFrame:
        """``batch`` and the number of new ``contents`` it brought."""
        rows = [(m["batch"], m["contents"]) for m in self._marks()]
        return self.spark.createDataFrame(rows, "batch long, contents long")

    def contents(self) -> DataFrame:
        """``sha256``, ``size``, ``payload``, ``prefix`` and ``batch`` of each distinct content."""
        marks = [m for m in self._marks() if m["contents"]]
        if not marks:
            empty = "sha256 string, size long, payload binary, prefix string, batch long"
            return self.spark.createDataFrame([], empty)
        batches = F.create_map(*[F.lit(v) for m in marks for v in (m["stamp"], m["batch"])])
        found = self._read(marks).withColumn("batch", F.element_at(batches, F.col("stamp")))
        return found.select("sha256", "size", "payload", F.col("prefix").cast("string").alias("prefix"), "batch")

    def unknown(self, hashes: DataFrame) -> DataFrame:
        """Those of the distinct ``sha256`` that are not stored. Only hashes are read, in the folders in question."""
        marks = self._marks()
        kept = [m for m in marks if m["contents"]]
        if not kept:
            return hashes
        words = kept[-1]["words"]
        bits = self.spark.read.parquet(*[f"{self.folder}/filter/{m['filter']}" for m in kept if m["words"] == words])
        scratch = Scratch(self.spark, "content-store")
        maybe = scratch.write(possible(hashes, bits, words), "maybe")
        folders = [r[0] for r in maybe.select(F.left("sha256", F.lit(PREFIX_DIGITS)).alias("p")).distinct().collect()]  # 4,096 at most
        if not folders:
            return hashes
        stored = self._read(kept).where(F.col("prefix").isin(folders)).select(F.col("sha256").alias("_sha"))
        known = maybe.join(stored, F.col("sha256") == F.col("_sha"), "left_semi")
        return hashes.join(scratch.write(known, "known"), "sha256", "left_anti")

    def append(self, attachments: DataFrame) -> int:
        """Store the contents of a batch that are new; returns how many. ``attachments`` is a table of ``write_table``."""
        marks = self._marks()
        scratch = Scratch(self.spark, "content-store")
        distinct = attachments.groupBy("sha256").agg(F.first("size").alias("size"))
        new = scratch.write(self.unknown(distinct), "new")
        measured = new.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
        stamp = uuid.uuid4().hex
        if measured["n"]:
            self._write(attachments, new, measured["bytes"], stamp)
        total = measured["n"] + sum(m["contents"] for m in marks)
        words, name = self._extend_filter(new, marks, total, stamp)
        row = (marks[-1]["batch"] + 1 if marks else 0, stamp, measured["n"], words, name)
        self.spark.createDataFrame([row], MARKS).coalesce(1).write.mode("append").parquet(f"{self.folder}/marks")
        return measured["n"]

    def _write(self, attachments: DataFrame, new: DataFrame, size: int, stamp: str) -> None:
        """The first copies of the new contents. Rows of known ones are dropped where they are read."""
        wanted = new.select(F.col("sha256").alias("_new"))
        small = skew.measured_bytes(wanted) <= skew.BROADCAST_BYTES
        fresh = attachments.join(F.broadcast(wanted) if small else wanted, F.col("sha256") == F.col("_new"), "left_semi")
        once = first_copies(fresh).select("sha256", "size", "payload").dropDuplicates(["sha256"])
        # A folder's contents are dealt over as many tasks as keep each near FILE_BYTES, whatever the number of folders; a
        # small batch has many folders to write as well, so it is not left to few tasks.
        owners = max(-(-size // FILE_BYTES), min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 16**PREFIX_DIGITS))
        parts = max(1, -(-size // (FILE_BYTES * 16**PREFIX_DIGITS)))
        deal = F.pmod(F.xxhash64("sha256"), F.lit(parts))
        prefixed = once.withColumn("prefix", F.left("sha256", F.lit(PREFIX_DIGITS)))
        dealt = prefixed.repartition(int(owners), "prefix", deal)
        dealt.write.partitionBy("prefix").parquet(f"{self.folder}/contents/stamp={stamp}")

    def _extend_filter(self, new: DataFrame, marks: list, total: int, stamp: str) -> tuple[int, str]:
        """Add the new hashes to the filter, or build a larger one of all; returns its size and the name of its part."""
        words = marks[-1]["words"] if marks else 0
        if total * BITS_PER_CONTENT <= words * 64:
            filter_bits(new, words).write.parquet(f"{self.folder}/filter/{stamp}")
            return words, stamp
        room = max(2 * total, self.least_contents)
        words = 1 << math.ceil(math.log2(room * BITS_PER_CONTENT / 64))
        kept = [m for m in marks if m["contents"]]
        hashes = new.select("sha256")
        if kept:
            hashes = hashes.unionByName(self._read(kept).select("sha256"))
        filter_bits(hashes, words).write.parquet(f"{self.folder}/filter/{stamp}")
        return words, stamp
