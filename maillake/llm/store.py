"""Intermediate tables of the operators, and the reading of the input tables."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..operators.lineage import Scratch

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, job: str) -> Scratch:
    """Tables of one run, under the folder that ``spark.checkpoint.dir`` names."""
    return Scratch(spark, job)


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches by bytes: texts may be very long, and a batch is in memory several times."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the given columns only: 52 bits of their MD5.

    MD5 rather than a faster hash, so that other SQL engines can state the same number.
    """
    text = F.concat_ws(":", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return bits / F.lit(float(2**52))


def per_process(name: str, make: Callable[[], T]) -> T:
    """An object that a Python worker makes once and keeps for its later tasks.

    Functions reach the workers by value, so what their modules hold lives for one task only.
    """
    kept = sys.modules.setdefault("_kept_by_worker", ModuleType("_kept_by_worker"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


def map_text(
    docs: DataFrame, run: Callable[..., list[pa.Array]], added: str, text: str | list[str] = "text", keep: bool = False
) -> DataFrame:
    """The columns of ``docs``, and the columns ``added`` that ``run`` makes from each batch of one or several texts.

    Columns travel under numbers, so no name of the input, in any case, meets a name of the operator; an input column
    named like an added one is replaced. The texts themselves go on only if they are to be kept.
    """
    texts = [text] if isinstance(text, str) else text
    fields = T_._parse_datatype_string(added)
    gone = {f.name.lower() for f in fields} | (set() if keep else {t.lower() for t in texts})
    kept = [f for f in docs.schema.fields if f.name.lower() not in gone]
    sent = [f.name for f in kept]
    for name in texts:
        if name.lower() not in [s.lower() for s in sent]:
            sent.append(name)
    places = [[s.lower() for s in sent].index(name.lower()) for name in texts]
    inner = docs.select(*[docs[quoted(name)].alias(f"c{i}") for i, name in enumerate(sent)])
    schema = T_.StructType([T_.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)])
    for i, f in enumerate(fields):
        schema = schema.add(f"a{i}", f.dataType)
    numbered = schema.names

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = run(*[batch.column(p) for p in places])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=numbered)

    found = inner.mapInArrow(over, schema)
    back = [F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)]
    return found.select(*back, *[F.col(f"a{i}").alias(f.name) for i, f in enumerate(fields)])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
