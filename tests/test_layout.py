"""Bucketed tables: results and plans without shuffles."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from checks import layouts
from conftest import SF
from maillake.operators import enrich, layout


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    """Small tables would be broadcast; the plans here are those of large ones."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def name():
    return f"t_{uuid.uuid4().hex}"


def test_header_joins_shuffle_nothing(spark, plan):
    text = plan(layouts.joined_headers(spark, SF))
    assert "SortMergeJoin" in text and "Exchange" not in text and "Bucketed: true" in text.replace("\n", " ")


def test_parent_lookup_shuffles_nothing_and_keeps_heavy_keys_apart(spark, plan):
    left, index = layouts.parent_tables(spark, SF, heavy_rows=20)
    assert left.heavy == ["m1@mail.example"]
    most = max(r["count"] for r in left.ordinary.groupBy("in_reply_to").count().collect())
    assert most < 20 and left.apart.where("in_reply_to is not null").count() >= 20
    text = plan(layout.lookup_split(left, index, "parent_id"))
    assert "SortMergeJoin" in text and "Exchange hashpartitioning" not in text


def test_a_grouping_on_the_key_needs_no_shuffle(spark, plan, tmp_path):
    df = spark.range(1000).selectExpr("id % 37 as k", "cast(id as string) as v")
    table = layout.write_bucketed(df, name(), str(tmp_path / "t"), ["k"], 4)
    assert "Exchange" not in plan(table.groupBy("k").agg(F.max("v")))
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, df.collect()))


def test_a_table_is_opened_again(spark, plan, tmp_path):
    df = spark.range(100).selectExpr("id as `my key`", "id * 2 as v")
    first, second, path = name(), name(), str(tmp_path / "it's here")
    layout.write_bucketed(df, first, path, ["my key"], 4)
    spark.sql(f"drop table {first}")
    again = layout.open_bucketed(spark, second, path, df.schema, ["my key"], 4)
    assert again.count() == 100
    joined = again.join(again.withColumnRenamed("v", "w"), "my key")
    assert joined.count() == 100 and "Exchange" not in plan(joined)


def test_nulls_and_empty_tables(spark, tmp_path):
    rows = [(None, 1), (None, 2), ("a", 3), ("hot", 4)] + [("hot", 10 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, v int")
    right = spark.createDataFrame([("a", "A"), ("hot", "H")], "id string, x string")
    index = layout.write_bucketed(right, name(), str(tmp_path / "i"), ["id"], 4)
    left = layout.write_split(df, name(), str(tmp_path), "k", 4, heavy_rows=10)
    found = layout.lookup_split(left, index, "id")
    assert sorted((r["v"], r["x"]) for r in found.collect() if r["x"]) == sorted([(3, "A"), *[(v, "H") for k, v in rows if k == "hot"]])
    assert found.count() == len(rows)
    empty = layout.write_split(df.limit(0), name(), str(tmp_path / "e"), "k", 4)
    assert layout.lookup_split(empty, index, "id").count() == 0


def test_bucket_numbers():
    mb = 1 << 20
    assert [layout.buckets_for(n * mb, 256 * mb) for n in (0, 1, 256, 257, 1000, 1025)] == [1, 1, 1, 2, 4, 8]
    assert enrich.HEADER_COLUMNS
