"""Merged roll-ups against values of all messages."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from maillake.operators import rollups

SCHEMA = "box string, day int, size long, participants array<string>, date_ts timestamp_ntz"


def mail(spark, n, rng):
    rows = []
    for i in range(n):
        who = [f"p{rng.randrange(4000)}" for _ in range(rng.randrange(4))]
        rows.append((rng.choice(["a", "b", None]), rng.randrange(5), rng.choice([None, rng.randrange(10_000)]), who, None))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_merging_equals_one_roll_up(spark):
    rows, df = mail(spark, 4000, random.Random(1))
    stored = rollups.roll_up(df.where("day < 2"), ["box", "day"])
    for day in (2, 3, 4):
        stored = stored.unionByName(rollups.roll_up(df.where(f"day = {day}"), ["box", "day"]))
    whole = rollups.merge(rollups.merge(stored, ["box", "day"]), ["box"])
    told = whole.select("*", rollups.people().alias("people"), rollups.size_quantile(0.9).alias("q")).collect()
    assert len(told) == 3
    for r in told:
        own = [x for x in rows if x[0] == r["box"]]
        people = len({p for x in own for p in x[3]})
        sizes = sorted(x[2] for x in own if x[2] is not None)
        assert (r["messages"], r["bytes"]) == (len(own), sum(sizes))
        assert abs(r["people"] - people) <= 0.03 * people
        assert abs(sum(s <= r["q"] for s in sizes) / len(sizes) - 0.9) < 0.03


def test_nulls_and_empty_tables(spark):
    rows = [("a", 1, None, [], None), ("a", 1, None, None, None), (None, None, 5, ["x", "x"], None)]
    rolled = rollups.merge(rollups.roll_up(spark.createDataFrame(rows, SCHEMA), ["box", "day"]), ["box"])
    told = {r["box"]: r for r in rolled.select("*", rollups.people().alias("people"), rollups.size_quantile(0.5).alias("q")).collect()}
    assert (told["a"]["messages"], told["a"]["bytes"], told["a"]["people"], told["a"]["q"]) == (2, 0, 0, None)
    assert (told[None]["messages"], told[None]["people"], told[None]["q"]) == (1, 1, 5)
    assert rollups.roll_up(spark.createDataFrame([], SCHEMA), ["box"]).count() == 0


def test_the_merge_reads_no_messages(spark, plan, tmp_path):
    _, df = mail(spark, 50, random.Random(2))
    rollups.roll_up(df, ["box", "day"]).write.parquet(str(tmp_path / "stored"))
    text = plan(rollups.merge(spark.read.parquet(str(tmp_path / "stored")), ["box"]))
    assert "participants" not in text and "Generate" not in text and text.count("FileScan") == 1
    assert spark.read.parquet(str(tmp_path / "stored")).select(F.max(F.octet_length("people_sketch"))).first()[0] < 1 << 15
