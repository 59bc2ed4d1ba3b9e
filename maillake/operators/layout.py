"""Tables laid out for their joins: bucketed by the join keys, so that joins and groupings on them shuffle nothing.

A corpus is joined many times on the same two keys: ``(mailbox, uid)`` for headers, bodies and known ids, and
``message_id`` for parents and indexes. Written once in buckets of that key, every later join reads bucket by bucket.

A bucket is read by one task, so a key that holds a large share of the rows (a message that thousands answer) must not
decide the bucket. ``write_split`` keeps the rows of such keys apart, in a table without buckets; their few partners are
broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import skew
from .lineage import Scratch

BUCKET_BYTES = 256 * 1024 * 1024


def buckets_for(table_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """A power of two, so that tables of different sizes still have buckets that divide each other."""
    return 1 << max(0, -(-table_bytes // bucket_bytes) - 1).bit_length()


def write_bucketed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Write ``df`` as table ``name`` under ``path``, one sorted file per bucket; returns the table."""
    dealt = df.repartition(buckets, *keys)
    writer = dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", path).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str, schema: T.StructType, keys: list[str], buckets: int) -> DataFrame:
    """A table that an earlier session has written, for catalogs that do not outlive their session."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = ", ".join(f"`{k}`" for k in keys)
    place = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return spark.table(name)


@dataclass
class Split:
    """Rows of ordinary keys in buckets, and those of the ``heavy`` keys (and of none) without."""

    ordinary: DataFrame
    apart: DataFrame
    heavy: list
    key: str


def write_split(
    df: DataFrame, name: str, path: str, key: str, buckets: int, heavy_rows: int = skew.HEAVY_ROWS, share: float | None = None
) -> Split:
    """Write ``df`` bucketed by ``key``. A key is kept apart from ``heavy_rows`` rows on, and from ``share`` of the rows,
    by default half a bucket. ``df`` is read twice, so it should be a stored table."""
    part = share if share is not None else max(skew.HEAVY_SHARE, 0.5 / buckets)
    heavy = skew.heavy_keys(df, key, heavy_rows, part)
    rare = ~F.col(key).isin(heavy) if heavy else F.lit(True)
    ordinary = write_bucketed(df.where(F.col(key).isNotNull() & rare), name, f"{path}/{name}", [key], buckets)
    apart = Scratch(df.sparkSession, "apart").write(df.where(F.col(key).isNull() | ~rare), name)
    return Split(ordinary, apart, heavy, key)


def lookup_split(left: Split, right: DataFrame, right_key: str) -> DataFrame:
    """Left look-up in a bucketed table that is unique by its key: no shuffle for ordinary keys, and the rows of heavy
    keys, at most 1 / ``HEAVY_SHARE`` different ones, are broadcast."""
    near = left.ordinary.join(right, F.col(left.key) == F.col(right_key), "left")
    few = right.where(F.col(right_key).isin(left.heavy)) if left.heavy else right.limit(0)
    far = left.apart.join(F.broadcast(few), F.col(left.key) == F.col(right_key), "left")
    return near.unionByName(far)
