"""Roots of a growing corpus against one full run."""

from __future__ import annotations

import random

import pytest

from maillake.operators import reply_chains
from maillake.operators.root_forest import RootForest
from test_reply_chains import SCHEMA


def mail(rng, n, ids):
    rows = []
    for i in range(n):
        own = rng.choice([f"m{rng.randrange(ids)}", f"m{rng.randrange(ids)}", None])
        parent = rng.choice([None, f"m{rng.randrange(ids)}", f"m{rng.randrange(ids)}", f"gone{rng.randrange(20)}"])
        refs = rng.choice([[], [], [], None, [f"r{rng.randrange(5)}", "x"]])
        rows.append((rng.randrange(3), i, own, parent, refs))
    return rows


def full(spark, rows, mode):
    found = reply_chains.thread_roots(spark.createDataFrame(rows, SCHEMA), mode)
    return sorted((r["mailbox_ord"], r["uid_n"], r["root_message_id"], r["reply_depth"]) for r in found.collect())


def stored(forest):
    return sorted((r["mailbox_ord"], r["uid_n"], r["root_message_id"], r["reply_depth"]) for r in forest.message_roots().collect())


def by_text(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("mode,seed", [("ancestor", 1), ("ancestor", 2), ("exact", 3)])
def test_batches_equal_a_full_run(spark, tmp_path, mode, seed):
    """Ids that come late, come again with another parent, and close or open cycles."""
    rng = random.Random(seed)
    rows = mail(rng, 120, 60)
    forest = RootForest(spark, str(tmp_path / "forest"), mode, heavy_rows=5)
    rng.shuffle(rows)
    for low, high in ((0, 50), (50, 51), (51, 90), (90, 90), (90, 120)):
        forest.append(spark.createDataFrame(rows[low:high], SCHEMA))
        if high in (90, 120):
            found = full(spark, rows[:high], mode)
            assert by_text(stored(forest)) == by_text(found)
        if high == 90:
            forest.compact()
            assert len(forest.versions()) == 1 and by_text(stored(forest)) == by_text(found)


def test_a_chain_that_comes_backwards(spark, tmp_path):
    rows = [(0, i, f"m{i}", f"m{i - 1}" if i else None, []) for i in range(40)]
    forest = RootForest(spark, str(tmp_path / "forest"))
    for part in (rows[30:], rows[10:30:2], rows[11:30:2], rows[:10]):
        forest.append(spark.createDataFrame(part, SCHEMA))
    assert {(r["root_message_id"], r["reply_depth"] - r["uid_n"]) for r in forest.message_roots().collect()} == {("m0", 0)}


def test_only_changed_ids_are_written_and_no_message_is_read_again(spark, tmp_path, plan):
    rows = [(0, i, f"m{i}", f"m{i - 1}" if i % 10 else None, []) for i in range(1000)]
    forest = RootForest(spark, str(tmp_path / "forest"))
    first = str(tmp_path / "mail")
    spark.createDataFrame(rows, SCHEMA).write.parquet(first)
    forest.append(spark.read.parquet(first))
    late = [(1, 1, "late", "m5", []), (1, 2, "m10", "m9", [])]  # a leaf, and a root that becomes an answer
    forest.append(spark.createDataFrame(late, SCHEMA))
    (_, old), (_, new) = forest.versions()
    assert spark.read.parquet(f"{forest.folder}/index-{new}").count() == 2
    changed = {r["id"] for r in spark.read.parquet(f"{forest.folder}/roots-{new}").collect()}
    # What ended at m10, and the newly answered m9; m5 is answered already and unchanged.
    assert changed == {f"m{i}" for i in range(10, 19)} | {"m9"}
    text = plan(forest.message_roots())
    assert first not in text and "root_forest" not in text
    roots = {r["message_id"]: r["root_message_id"] for r in forest.message_roots().where("mailbox_ord = 0").collect()}
    assert roots["m15"] == "m0" and roots["m25"] == "m20"


def test_a_batch_without_its_mark_is_not_read(spark, tmp_path, monkeypatch):
    rows = [(0, 1, "a", "b", []), (0, 2, "b", None, [])]
    forest = RootForest(spark, str(tmp_path / "forest"))
    forest.append(spark.createDataFrame(rows[:1], SCHEMA))
    monkeypatch.setattr(forest, "_mark", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        forest.append(spark.createDataFrame(rows[1:], SCHEMA))
    monkeypatch.undo()
    assert [tuple(r) for r in forest.message_roots().collect()] == [(0, 1, "a", "b", 1)]
    forest.append(spark.createDataFrame(rows[1:], SCHEMA))
    assert sorted(tuple(r) for r in forest.message_roots().collect()) == [(0, 1, "a", "b", 1), (0, 2, "b", "b", 0)]


def test_an_empty_forest(spark, tmp_path):
    forest = RootForest(spark, str(tmp_path / "forest"))
    assert forest.roots().count() == 0
    with pytest.raises(ValueError):
        forest.message_roots()
    forest.append(spark.createDataFrame([], SCHEMA))
    assert forest.message_roots().count() == 0
