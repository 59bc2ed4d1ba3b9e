"""The growing content store against plain sets."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from maillake.operators import attachments, content_store
from maillake.operators.content_store import ContentStore

SCHEMA = "mailbox string, uid string, part_index int, size long, sha256 string, payload binary"


def batch(spark, contents, start=0):
    rows = [
        ("box", str(start + i), i % 3, len(c), hashlib.sha256(c.encode()).hexdigest(), c.encode()) for i, c in enumerate(contents)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def held(store):
    return sorted((r["payload"].decode(), r["batch"]) for r in store.contents().collect())


def test_batches_with_common_contents(spark, tmp_path):
    rng = random.Random(3)
    store, known, want = ContentStore(spark, str(tmp_path / "s"), least_contents=8), set(), []
    for number in range(5):  # the filter is rebuilt on the way
        own = [f"c{rng.randrange(10 ** (number % 3 + 1))}" for _ in range(60)] + ["logo"] * 20
        new = sorted(set(own) - known)
        assert store.append(batch(spark, own, 1000 * number)) == len(new)
        known |= set(new)
        want += [(c, number) for c in new]
        assert held(store) == sorted(want)
    prefixes = {(r["sha256"][:3], r["prefix"]) for r in store.contents().select("sha256", "prefix").collect()}
    assert all(a == b for a, b in prefixes)
    assert [r["contents"] for r in store.history().orderBy("batch").collect()] == [sum(b == n for _, b in want) for n in range(5)]


def test_empty_batches_and_an_empty_store(spark, tmp_path):
    store = ContentStore(spark, str(tmp_path / "s"))
    assert store.contents().count() == 0
    assert store.append(batch(spark, [])) == 0 and store.contents().count() == 0
    assert store.append(batch(spark, ["", "x"])) == 2
    assert store.append(batch(spark, ["x", ""])) == 0
    assert held(store) == [("", 1), ("x", 1)]


def test_the_filter_has_no_false_negatives_and_few_false_positives(spark):
    hashes = spark.range(4000).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    words = 1 << 10  # 16 bits for each content
    bits = content_store.filter_bits(hashes, words)
    assert content_store.possible(hashes, bits.union(bits.limit(5)), words).count() == 4000
    others = spark.range(10_000, 30_000).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    assert content_store.possible(others, bits, words).count() < 200


def test_bytes_of_known_contents_are_dropped_where_they_are_read(spark, tmp_path, monkeypatch, plan):
    """The rows that are dealt to the folders are those of new contents only."""
    store = ContentStore(spark, str(tmp_path / "s"))
    store.append(batch(spark, [f"c{i}" for i in range(50)]))
    path = str(tmp_path / "table")
    batch(spark, [f"c{i}" for i in range(45, 55)] * 3).write.parquet(path)
    texts = []
    real = content_store.first_copies
    monkeypatch.setattr(content_store, "first_copies", lambda df: (texts.append(plan(df)), real(df))[1])
    assert store.append(spark.read.parquet(path)) == 5
    (text,) = texts
    assert "BroadcastHashJoin" in text and "LeftSemi" in text and "Exchange hashpartitioning" not in text


def test_a_batch_that_failed_is_not_read(spark, tmp_path, monkeypatch):
    store = ContentStore(spark, str(tmp_path / "s"))
    store.append(batch(spark, ["a"]))
    monkeypatch.setattr(store, "_extend_filter", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    try:
        store.append(batch(spark, ["b"]))
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert held(store) == [("a", 0)]
    assert store.append(batch(spark, ["b", "a"])) == 1 and held(store) == [("a", 0), ("b", 1)]


def test_folders_are_written_by_many_tasks(spark, tmp_path):
    rows = batch(spark, [f"c{i}" for i in range(200)])
    ContentStore(spark, str(tmp_path / "s")).append(rows)
    attachments.write_store(rows, str(tmp_path / "t"))
    for files in ((tmp_path / "s" / "contents").rglob("*.parquet"), (tmp_path / "t").rglob("*.parquet")):
        found = [(f.parent.name, f.name.split("-")[1]) for f in files]
        assert len({task for _, task in found}) > 1 and len({folder for folder, _ in found}) == len(found)
