"""Attachment tables: inventory, roll-ups, de-duplication and saving."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from . import skew
from .mime import filename, is_attachment

# Longest hash prefix used as a folder of the content store: 4,096 folders.
PREFIX_DIGITS = 3


def inventory(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per attachment: message keys, part index, record, stored name and (if kept) the bytes."""
    keys = keys or ("mailbox", "uid")
    parts = parsed.select(*keys, F.explode(F.filter("parts", is_attachment)).alias("p"))
    part = F.col("p")
    named = parts.select(
        *keys,
        part["part_index"].alias("part_index"),
        F.coalesce(filename(part), F.lit("")).alias("filename"),
        part["content_type"].alias("content_type"),
        part["size"].alias("size"),
        part["sha256"].alias("sha256"),
        names.content_id(part["content_id_header"]).alias("content_id"),
        part["payload"].alias("payload"),
    )
    return named.withColumn("stored_name", names.stored_name("filename", "mailbox", "uid", "part_index"))


def exploded(messages: DataFrame, *keys: str) -> DataFrame:
    """One row per attachment record of an exported table."""
    return messages.select(*(keys or ("mailbox", "uid")), F.inline("attachments"))


def rollup(attachments: DataFrame, *by: str) -> DataFrame:
    """Number, bytes and distinct contents of attachments."""
    return attachments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attachments"),
        F.sum("size").alias("bytes"),
        F.countDistinct("sha256").alias("contents"),
    )


def dedup(attachments: DataFrame) -> DataFrame:
    """One row per content: uses, size, bytes saved by storing it once, and its distinct names.

    Names are counted, not collected: one logo may carry a different name in every message. The name
    list itself is the table ``content_names``.
    """
    return (
        attachments.groupBy("sha256")
        .agg(
            F.count(F.lit(1)).alias("uses"),
            F.first("size").alias("size"),
            F.countDistinct("filename").alias("names"),
            F.min("filename").alias("first_name"),
        )
        .withColumn("saved_bytes", F.col("size") * (F.col("uses") - 1))
    )


def content_names(attachments: DataFrame) -> DataFrame:
    """Every distinct name of every content, with its uses."""
    return attachments.groupBy("sha256", "filename").agg(F.count(F.lit(1)).alias("uses"))


def write_table(attachments: DataFrame, path: str, mode: str = "overwrite") -> None:
    """All attachments with their bytes as a Parquet table. No shuffle: each task writes what it parsed."""
    attachments.write.mode(mode).parquet(path)


def first_copies(attachments: DataFrame, keys: tuple[str, ...] = ("mailbox", "uid", "part_index")) -> DataFrame:
    """The first attachment of each content, with its bytes.

    The first ones are found on narrow rows, combined before the shuffle. They are looked up by their whole key, so
    the copies of a frequent content do not meet; if the list is small, no bytes move at all.
    """
    place = F.struct(*keys)
    first = attachments.groupBy("sha256").agg(F.min(place).alias("_first"))
    small = skew.measured_bytes(first) <= skew.BROADCAST_BYTES
    first = first.withColumnRenamed("sha256", "_content")
    same = (F.col("sha256") == F.col("_content")) & (place == F.col("_first"))
    return attachments.join(F.broadcast(first) if small else first, same, "left_semi")


def write_store(attachments: DataFrame, path: str, mode: str = "overwrite", owner_bytes: int = 1 << 30) -> None:
    """Each distinct content once, partitioned by the first digits of its hash.

    ``attachments`` is the stored table of ``write_table``; its keys are those of ``inventory``. Only the first copy
    of each content is moved, to as many tasks as leave each ``owner_bytes`` or less. Prefixes have at most
    ``PREFIX_DIGITS`` digits; beyond that many folders, the contents of one are dealt over several tasks by their hash.
    """
    contents = attachments.groupBy("sha256").agg(F.first("size").alias("size"))
    total = contents.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]
    digits = 1
    while 16**digits * owner_bytes < total:
        digits += 1
    owners = max(1, -(-total // owner_bytes))
    prefix = F.left("sha256", F.lit(min(digits, PREFIX_DIGITS)))
    once = first_copies(attachments).select("sha256", "size", "payload").dropDuplicates(["sha256"])
    parts = max(1, -(-owners // 16 ** min(digits, PREFIX_DIGITS)))
    deal = F.pmod(F.xxhash64("sha256"), F.lit(int(parts)))
    # Each folder is one task's as before, but few bytes are no reason to leave all folders to one task.
    tasks = max(owners, min(int(once.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16 ** min(digits, PREFIX_DIGITS)))
    stored = once.withColumn("prefix", prefix).repartition(int(tasks), "prefix", deal)
    stored.write.mode(mode).partitionBy("prefix").parquet(path)


def check_shared(spark: SparkSession, folder: str) -> None:
    """Raise unless the executors see what the driver writes into ``folder``. A local session needs no check."""
    if spark.conf.get("spark.master", "local").startswith("local["):
        return
    os.makedirs(folder, exist_ok=True)
    mark = os.path.join(folder, f".mark-{uuid.uuid4().hex}")
    with open(mark, "w"):
        pass

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [os.path.exists(mark)] * batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.bool_())], names=["seen"])

    tasks = spark.sparkContext.defaultParallelism
    seen = spark.range(0, tasks, 1, tasks).mapInArrow(look, "seen boolean").agg(F.bool_and("seen")).first()[0]
    os.remove(mark)
    if not seen:
        raise RuntimeError(f"{folder} is not shared by all executors")


def save_files(attachments: DataFrame, folder: str) -> DataFrame:
    """Write each attachment as a file under ``folder/<mailbox>/`` and add ``saved_path``.

    ``folder`` is a mount every executor sees, which is checked first. A failed write leaves ``saved_path`` null and keeps the row.
    The name is complete and the rename atomic, so a repeated task just writes the same file again. Lazy:
    the files appear when the result is computed.
    """
    check_shared(attachments.sparkSession, folder)
    staged = attachments.withColumn("saved_path", names.saved_path(folder, "mailbox", F.col("stored_name")))
    kept = [f for f in staged.schema.fields if f.name != "payload"]

    def store(path: str, data: bytes) -> str | None:
        try:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = f"{path}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as out:
                out.write(data)
            os.replace(part, path)
            return path
        except OSError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("saved_path").to_pylist()
            saved = [store(p, d.as_py() or b"") for p, d in zip(paths, batch.column("payload"))]
            rest = batch.drop_columns(["payload"])
            at = rest.schema.get_field_index("saved_path")
            yield rest.set_column(at, "saved_path", pa.array(saved, pa.string()))

    return staged.mapInArrow(run, T.StructType(kept))
