"""Mailbox selection, limits and profiles against plain Python."""

from __future__ import annotations

import random

import pytest

from maillake.operators import mailboxes


def corpus(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for box, size, step in (("hot", 3000, 3), ("mid", 200, 50), ("one", 1, 1), ("sparse", 40, 100_000)):
        uid = 0
        for _ in range(size):
            uid += rng.randint(1, step)
            rows.append((box, uid))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "mailbox string, uid_n long")


@pytest.mark.parametrize("limit", [1, 40, 41, 199, 200, 201, 2999, 5000])
def test_limit(spark, limit):
    rows, df = corpus(spark)
    kept = mailboxes.limit_per_mailbox(df, limit, width=64)
    want = []
    for box in {b for b, _ in rows}:
        want += [(box, u) for u in sorted(u for b, u in rows if b == box)[:limit]]
    assert sorted(tuple(r) for r in kept.collect()) == sorted(want)


@pytest.mark.parametrize("limit", [None, 0, -3])
def test_no_limit(spark, limit):
    rows, df = corpus(spark)
    assert mailboxes.limit_per_mailbox(df, limit).count() == len(rows)


def test_limit_without_broadcast(spark, monkeypatch):
    rows, df = corpus(spark)
    monkeypatch.setattr(mailboxes.skew, "BROADCAST_BYTES", -1)
    kept = mailboxes.limit_per_mailbox(df, 100, width=64)
    assert kept.columns == df.columns
    assert kept.count() == 100 + 100 + 1 + 40


def test_select_and_missing(spark):
    _, df = corpus(spark)
    names = mailboxes.parse_mailbox_list("one, nowhere ,,sparse,one")
    assert names == ["one", "nowhere", "sparse", "one"]
    chosen = mailboxes.select_mailboxes(df, names)
    assert sorted((r["mailbox"], r["mailbox_ord"]) for r in chosen.groupBy("mailbox", "mailbox_ord").count().collect()) == [
        ("one", 0), ("one", 3), ("sparse", 2),
    ]
    assert chosen.count() == 42
    assert [r["mailbox"] for r in mailboxes.missing_mailboxes(df, names).collect()] == ["nowhere"]


def test_profile(spark):
    _, df = corpus(spark)
    names = mailboxes.requested(spark, ["mid", "nowhere", "empty"])
    readable = spark.createDataFrame([("mid",), ("empty",)], "mailbox string")
    assert {r["mailbox"]: r["messages"] for r in mailboxes.profile(df, names, readable).collect()} == {
        "mid": 200, "nowhere": -1, "empty": 0,
    }
    assert tuple(mailboxes.preview(names, 2).first()) == (3, "mid,nowhere")
    assert tuple(mailboxes.preview(names.limit(0)).first()) == (0, "")


def test_drop_repeated(spark):
    rows = [(0, 5, "a"), (0, 2, "a"), (1, 1, "a"), (1, 2, None), (1, 3, None), (1, 4, "b")]
    df = spark.createDataFrame(rows, "mailbox_ord int, uid_n long, message_id string")
    kept = sorted((r["mailbox_ord"], r["uid_n"]) for r in mailboxes.drop_repeated(df).collect())
    assert kept == [(0, 2), (1, 2), (1, 3), (1, 4)]


def test_text_uids_are_neither_lost_nor_kept_by_mistake(spark):
    rows = [("a", None, f"p{i}", f"m{i % 5}") for i in range(10)]
    df = spark.createDataFrame(rows, "mailbox string, uid_n long, uid string, message_id string")
    assert mailboxes.drop_repeated(df).count() == 5
    assert mailboxes.limit_per_mailbox(df, 3).count() == 3
    mixed = df.unionByName(spark.createDataFrame([("a", i, str(i), None) for i in range(10)], df.schema))
    kept = mailboxes.limit_per_mailbox(mixed, 15).collect()
    assert len(kept) == 15 and sum(r["uid_n"] is not None for r in kept) == 10
    assert mailboxes.limit_per_mailbox(mixed, 7).where("uid_n < 7").count() == 7


def test_missing_mailboxes_scan_only_the_requested_ones(spark, tmp_path, plan):
    _, df = corpus(spark)
    df.write.partitionBy("mailbox").parquet(str(tmp_path / "raw"))
    text = plan(mailboxes.missing_mailboxes(spark.read.parquet(str(tmp_path / "raw")), ["one", "nowhere"]))
    assert "IN (nowhere,one)" in text.split("PartitionFilters:")[1].split("\n")[0]


def counted(rows):
    from collections import Counter

    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("limit,want", [(2, 2), (3, 3), (4, 4), (5, 4)])
def test_equal_uids_at_the_limit(spark, limit, want):
    df = spark.createDataFrame([("b", 7, "x"), ("b", 7, "x"), ("b", 7, "y"), ("b", 8, "z")], "mailbox string, uid_n long, v string")
    kept = mailboxes.limit_per_mailbox(df, limit).collect()
    assert len(kept) == want and not counted(kept) - counted(df.collect())


def test_messages_without_uid_at_the_limit(spark):
    df = spark.createDataFrame([("b", None, None)] * 10, "mailbox string, uid_n long, uid string")
    assert mailboxes.limit_per_mailbox(df, 3).count() == 3


@pytest.mark.parametrize("bound", [64 << 20, -1])
def test_limits_over_many_ties(spark, monkeypatch, bound):
    """Exactly as many rows as asked for, the smallest uids, and no row more often than it is there."""
    monkeypatch.setattr(mailboxes.skew, "BROADCAST_BYTES", bound)
    rng = random.Random(4)
    rows = []
    for box, size in (("a", 300), (None, 120), ("c", 5)):
        for _ in range(size):
            uid = rng.choice([None, rng.randrange(6), rng.randrange(1000)])
            rows.append((box, uid, rng.choice([None, "t1", "t2"]), rng.choice(["x", "y"]), [rng.randrange(2)]))
    df = spark.createDataFrame(rows, "mailbox string, uid_n long, uid string, v string, w array<int>").repartition(3)
    for limit in (1, 17, 119, 120, 150, 299, 300):
        kept = [(r["mailbox"], r["uid_n"], r["uid"], r["v"], tuple(r["w"])) for r in mailboxes.limit_per_mailbox(df, limit, width=4).collect()]
        have = counted([(*r[:4], tuple(r[4])) for r in rows])
        assert not counted(kept) - have
        for box in ("a", None, "c"):
            own = sorted((u is None, u or 0) for b, u, *_ in rows if b == box)[:limit]
            assert sorted((u is None, u or 0) for b, u, *_ in kept if b == box) == own


def test_repeated_rows_leave_one(spark):
    rows = [("m", 0, "b", 1, "1")] * 3 + [("n", 0, "b", 2, "2"), (None, 0, "b", 3, "3"), (None, 0, "b", 3, "3")]
    df = spark.createDataFrame(rows, "message_id string, mailbox_ord int, mailbox string, uid_n long, uid string")
    assert sorted(r["uid"] for r in mailboxes.drop_repeated(df).collect()) == ["1", "2", "3", "3"]
    assert mailboxes.drop_repeated(df.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [64 << 20, -1])
def test_random_repetitions(spark, monkeypatch, bound):
    monkeypatch.setattr(mailboxes.skew, "BROADCAST_BYTES", bound)
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c", f"m{rng.randrange(40)}", None]), rng.choice([None, 0, 1]), rng.choice([None, 1, 2]), rng.choice("xy")) for _ in range(300)]
    df = spark.createDataFrame(rows, "message_id string, mailbox_ord int, uid_n long, v string").repartition(4)
    kept = [tuple(r) for r in mailboxes.drop_repeated(df).collect()]
    assert not counted(kept) - counted(rows)
    assert sum(r[0] is None for r in kept) == sum(r[0] is None for r in rows)
    place = lambda r: (r[1] is None, r[1] or 0, r[2] is None, r[2] or 0)
    named = {r[0]: r for r in kept if r[0]}
    assert len(named) == sum(r[0] is not None for r in kept) == len({r[0] for r in rows if r[0]})
    assert all(place(named[k]) == min(place(r) for r in rows if r[0] == k) for k in named)
