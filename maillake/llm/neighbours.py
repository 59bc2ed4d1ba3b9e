"""Each row beside the next one in the order of a key, without a task that sees all rows.

1. A narrow table (key, text hash, place in the input) is dealt by ranges; the first entry of each range is a border.
   Only borders, one per range, reach the driver.
2. Every row goes to the range that it belongs to, and a copy of each range's first row goes to the end of the range
   before: one shuffle of the texts.
3. Ranges are read in order; the row after each row is the next one. After the last row comes the first.

Rows of one key are in the order of their texts' hashes; equal rows are told apart by their places, so a key or row that
holds a large share of the table is spread over many ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lineage import Scratch
from .store import quoted

RANGES = 4  # per shuffle partition, so that the ranges of a task even out
_LOW = 2**63


def _place(key: Column, text: Column) -> list[Column]:
    return [
        key.isNotNull().cast("long").alias("_known"),
        F.coalesce(key.cast("long"), F.lit(0)).alias("_key"),
        F.xxhash64(text).alias("_hash"),
        F.monotonically_increasing_id().alias("_nth"),
    ]


def _as_bytes(*columns: np.ndarray) -> np.ndarray:
    """Rows of signed numbers as byte strings in the same order."""
    wide = np.stack([(c.astype(np.int64).astype(np.uint64) + np.uint64(_LOW)) for c in columns], axis=1)
    return np.ascontiguousarray(wide.astype(">u8")).view(f"S{8 * len(columns)}").ravel()


def borders(rows: DataFrame, ranges: int, tables: Scratch) -> list[tuple[int, int, int, int]]:
    """The first entry of each range, in order; at most ``ranges`` of them."""
    order = ["_known", "_key", "_hash", "_nth"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    found = tables.write(dealt.mapInArrow(first, rows.schema), "borders")
    return sorted(tuple(r) for r in found.collect())


def with_next(docs: DataFrame, key: str, text: str, tables: Scratch) -> DataFrame:
    """``key``, ``text`` (a null one is empty) and ``next_text``, the text of the row that follows by ``key``.

    ``key`` is an integer; rows without a key come first. An empty table gives an empty one; a row alone follows itself.
    Other columns are left out.
    """
    spark = docs.sparkSession
    whole = F.coalesce(docs[quoted(text)], F.lit(""))
    rows = docs.select(*_place(docs[quoted(key)], whole), whole.alias("_text"))
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = borders(rows.drop("_text"), ranges, tables)
    schema = T.StructType().add(key, docs.schema[key].dataType).add(text, T.StringType()).add("next_text", T.StringType())
    if not bounds:
        return spark.createDataFrame([], schema)
    marks = _as_bytes(*np.array(bounds, np.int64).T)

    @F.pandas_udf("int")
    def range_of(known: pd.Series, number: pd.Series, digest: pd.Series, nth: pd.Series) -> pd.Series:
        own = _as_bytes(known.to_numpy(), number.to_numpy(), digest.to_numpy(), nth.to_numpy())
        return pd.Series(np.maximum(np.searchsorted(marks, own, side="right") - 1, 0).astype(np.int32))

    # The head of each range, found by value: rows of equal key and text are the same row here. Each value is looked for
    # once, however many ranges begin with it.
    names = "_k long, _n long, _h long"
    values = spark.createDataFrame(sorted({b[:3] for b in bounds}), names)
    targets = spark.createDataFrame([(*b[:3], (i - 1) % len(bounds)) for i, b in enumerate(bounds)], f"{names}, _range int")
    same = (F.col("_known") == F.col("_k")) & (F.col("_key") == F.col("_n")) & (F.col("_hash") == F.col("_h"))
    found = rows.join(F.broadcast(values), same).groupBy("_k", "_n", "_h").agg(F.min("_text").alias("_text"))
    first = found.join(F.broadcast(targets), ["_k", "_n", "_h"])
    dealt = rows.select(
        range_of("_known", "_key", "_hash", "_nth").alias("_range"), F.lit(0).alias("_tail"), "_known", "_key", "_hash", "_text"
    )
    tails = first.select("_range", F.lit(1).alias("_tail"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), "_text")
    both = dealt.union(tails).repartition(ranges // RANGES, "_range")
    ordered = both.sortWithinPartitions("_range", "_tail", "_known", "_key", "_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, whose next one is still to come
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield from pairs(held, batch.slice(0, 1))
            yield from pairs(batch.slice(0, batch.num_rows - 1), batch.slice(1))
            held = batch.slice(batch.num_rows - 1)
        # What is held in the end is the head of another range.

    def pairs(row: pa.RecordBatch, after: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = pc.equal(row.column(1), 0)
        if row.num_rows and pc.any(own).as_py():
            number = pc.if_else(pc.equal(row.column(2), 1), row.column(3), pa.scalar(None, pa.int64()))
            arrays = [a.filter(own) for a in (number, row.column(5), after.column(5))]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, text, "next_text"])

    inner = T.StructType().add(key, T.LongType()).add(text, T.StringType()).add("next_text", T.StringType())
    return ordered.mapInArrow(run, inner).withColumn(key, F.col(key).cast(docs.schema[key].dataType))
