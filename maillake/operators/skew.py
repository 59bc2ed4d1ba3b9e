"""Look-up joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when its measured size is below this.
BROADCAST_BYTES = 64 * 1024 * 1024
# A key is heavy from this share of the rows on, so there are at most 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 0.001
HEAVY_ROWS = 1_000_000
SALTS = 64
SLOTS = 1 << 14  # of keys that are counted together first


def _text_of(field: T.StructField) -> Column | None:
    """The variable-width part of a column as text; None for fixed-width types."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.col(field.name)
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(F.struct(field.name))
    return None


def measured_bytes(df: DataFrame) -> int:
    """Upper estimate of the in-memory size, from one pass over the (narrow) table."""
    texts = [t for t in map(_text_of, df.schema.fields) if t is not None]
    width = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(16 * (len(df.columns) + 2)))
    return df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("n")).first()["n"]


def heavy_keys(
    df: DataFrame, key: str, rows: int = HEAVY_ROWS, share: float = HEAVY_SHARE, total: int | None = None
) -> list:
    """Keys holding at least ``share`` of the rows (and ``rows`` of them): at most 1 / share values.

    ``total`` saves the counting where the number of rows is known. ``df`` is read for the counts, so it
    should be a stored table rather than a long computation.
    """
    keyed = df.where(F.col(key).isNotNull())
    total = keyed.count() if total is None else total
    bound = max(rows, total * share)
    # A table with fewer rows than the bound cannot hold a heavy key: no grouping then.
    if total < bound:
        return []
    counts = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return [r[key] for r in counts.where(F.col("n") >= bound).select(key).collect()]


def heavy_keys_stored(df: DataFrame, key: str, rows: int = HEAVY_ROWS, share: float = HEAVY_SHARE) -> list:
    """The same keys from a stored table, without a shuffle of all of them.

    A key has no more rows than the slot its hash falls into, so only keys of slots with enough rows are counted exactly.
    """
    keyed = df.where(F.col(key).isNotNull())
    total = keyed.count()
    bound = max(rows, total * share)
    if total < bound or total < 64 * SLOTS:  # few rows are grouped by their key at once
        return heavy_keys(keyed, key, rows, share, total)
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    counts = keyed.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    full = [r["slot"] for r in counts.where(F.col("n") >= bound).collect()]
    return heavy_keys(keyed.where(slot.isin(full)), key, math.ceil(bound), 0.0, total) if full else []


def heavy_counts(counts: DataFrame, key: str, n: str, rows: int = HEAVY_ROWS, share: float = HEAVY_SHARE) -> list:
    """The same from a stored table of the keys and their numbers of rows."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return [r[key] for r in counts.where(F.col(n) >= max(rows, total * share)).select(key).collect()]


def lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    right_key: str,
    spread_by: list[str],
    heavy: list | None = None,
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Join with a side that is unique by its key; the right key column is dropped.

    Rows of a heavy key are spread over ``salts`` tasks and only that key's right row is repeated.
    Rows without a key, which match nothing, are spread as well instead of meeting in one task.
    ``spread_by`` names columns that identify a left row, so a retried task salts the same way.
    """
    slot = F.xxhash64(*spread_by)
    hot = heavy or []
    left_salt: Column = F.when(F.col(key).isNull(), F.pmod(slot, F.lit(1024)))
    right_salts: Column = F.array(F.lit(0))
    if hot:
        left_salt = left_salt.when(F.col(key).isin(hot), F.pmod(slot, F.lit(salts)))
        every = F.sequence(F.lit(0), F.lit(salts - 1))
        right_salts = F.when(F.col(right_key).isin(hot), every).otherwise(right_salts)
    salted_left = left.withColumn("_salt", left_salt.otherwise(F.lit(0)).cast("int"))
    salted_right = right.withColumn("_right_salt", F.explode(right_salts) if hot else F.lit(0))
    matched = (F.col(key) == F.col("_right_key")) & (F.col("_salt") == F.col("_right_salt"))
    joined = salted_left.join(salted_right.withColumnRenamed(right_key, "_right_key"), matched, how)
    return joined.drop("_salt", "_right_salt", "_right_key")


def lookup_measured(
    left: DataFrame, right: DataFrame, key: str, right_key: str, spread_by: list[str], limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Left look-up: broadcast when the right side is measured to be small, else the salted join."""
    if measured_bytes(right) <= limit:
        small = F.broadcast(right.withColumnRenamed(right_key, "_right_key"))
        return left.join(small, F.col(key) == F.col("_right_key"), "left").drop("_right_key")
    return lookup(left, right, key, right_key, spread_by, heavy_keys(left, key))
