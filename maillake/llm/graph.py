"""Connected components as joins, and blocks of rows streamed through Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators import threads
from ..operators.lineage import Scratch

HUB_ROWS = 10_000  # a node with so many edges is looked up by many tasks


def components(edges: DataFrame, tables: Scratch, name: str) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for all nodes of edges ``a``, ``b``."""
    return threads.components(edges, tables, name, HUB_ROWS)


def map_blocks(
    df: DataFrame, key: str, function: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str | T.StructType
) -> DataFrame:
    """Run a function on the rows of each key. Keys are bounded blocks; many small ones share a task and a batch.

    Like a grouped map, without its cost per group: rows come sorted by key and are cut where the key changes.
    """
    # With a number: adaptive execution would put a small table with much work into one task.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(tasks, key).sortWithinPartitions(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key))
            if not batch.num_rows:
                continue
            changes = pc.indices_nonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))).to_pylist()
            start = 0
            if held:
                before = held[-1].column(batch.schema.get_field_index(key))
                if before[len(before) - 1].as_py() != keys[0].as_py():
                    yield from function(pa.Table.from_batches(held))
                    held = []
            for change in changes:
                held.append(batch.slice(start, change + 1 - start))
                yield from function(pa.Table.from_batches(held))
                held, start = [], change + 1
            held.append(batch.slice(start))
        if held:
            yield from function(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema)
