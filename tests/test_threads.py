"""Threads of all references against union-find, and components against a plain walk."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from checks import views
from maillake.operators import skew, threads
from maillake.operators.lineage import Scratch

SCHEMA = (
    "mailbox_ord int, uid_n long, message_id string, in_reply_to string, references array<string>,"
    " subject_canonical string, date_utc string"
)


def joined(pairs):
    """Smallest member of each node's component."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def plain_threads(rows):
    """(thread, merged) of each row, written from the description of the rule."""
    node = {}
    for row in rows:
        node[row[:2]] = (0, row[2]) if row[2] else (1, row[:2])
    pairs = []
    for row in rows:
        own = node[row[:2]]
        pairs += [(own, own)] + [(own, (0, r)) for r in [*(row[4] or []), row[3]] if r]
    component = joined(pairs)
    groups = {}
    for row in rows:
        groups.setdefault(component[node[row[:2]]], []).append(row)
    topic = {}
    for name, own in groups.items():
        begun = any(r[2] and not r[3] and not r[4] for r in own)
        first = min(own, key=lambda r: (not r[6], r[6] or "", r[:2]))
        subject = (first[5] or "").lower()
        if not begun and subject:
            topic.setdefault((subject, (first[6] or "unknown")[:10]), []).append(name)
    merged = {name: min(names) for names in topic.values() if len(names) > 1 for name in names}
    return {row[:2]: (merged.get(c := component[node[row[:2]]], c), c in merged) for row in rows}


def random_mail(rng, n):
    ids = [f"{rng.choice('abc')}{i}@x" for i in range(n)] + ["hub@x"]
    rows = []
    for i in range(n):
        own = rng.choice([ids[i], ids[i], ids[i], rng.choice(ids), None])
        parent = rng.choice([None, None, rng.choice(ids), f"gone{rng.randrange(n)}@x"])
        refs = [rng.choice(ids) for _ in range(rng.choice([0, 0, 0, 1, 2]))] + (["hub@x"] if i % 5 == 0 and i % 2 else [])
        sent = rng.choice([None, f"2024-01-0{rng.randint(1, 3)}T0{rng.randint(0, 9)}:00:00Z"])
        rows.append((rng.randint(0, 2), i, own, parent, refs or rng.choice([[], None]), rng.choice(["", None, "Plan", "plan", "Ask"]), sent))
    return rows


@pytest.mark.parametrize("seed,n,heavy", [(1, 1, 1), (2, 12, 1), (3, 60, 3), (4, 400, 20), (5, 400, 10**6)])
def test_threads_equal_a_plain_union(spark, seed, n, heavy):
    rows = random_mail(random.Random(seed), n)
    found = threads.reference_threads(spark.createDataFrame(rows, SCHEMA).repartition(3), heavy_rows=heavy).collect()
    want = plain_threads(rows)
    got = {(r["mailbox_ord"], r["uid_n"]): r for r in found}
    assert len(found) == n
    for key, (name, merged) in want.items():
        assert got[key]["merged"] == merged
        if name[0] == 0:
            assert got[key]["thread_id"] == name[1]
    # Threads without any id have a key of their own, the same for all their messages.
    names = {}
    for key, (name, _) in want.items():
        names.setdefault(name, set()).add(got[key]["thread_id"])
    assert all(len(v) == 1 for v in names.values()) and len({min(v) for v in names.values()}) == len(names)


def test_an_empty_table(spark):
    assert threads.reference_threads(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("shape", ["chain", "ordered", "star", "random", "loops"])
def test_components(spark, shape):
    rng = random.Random(7)
    name = {i: f"{i:05d}" if shape == "ordered" else f"{rng.randrange(10**6):06d}-{i}" for i in range(3000)}
    pairs = {
        "chain": [(i, i + 1) for i in range(500)],
        "ordered": [(i, i + 1) for i in range(2900)],
        "star": [(0, i) for i in range(1, 500)],
        "random": [(rng.randrange(600), rng.randrange(600)) for _ in range(350)],
        "loops": [(i, i) for i in range(5)],
    }[shape]
    named = [(name[a], name[b]) for a, b in pairs]
    df = spark.createDataFrame(named, "a string, b string")
    found = threads.components(df, Scratch(spark, "test"), heavy_rows=20)
    want = {k: v for k, v in joined([p for p in named if p[0] != p[1]]).items()}
    assert {r["node"]: r["component"] for r in found.collect()} == want


def test_a_hub_is_spread_over_tasks(spark, monkeypatch):
    """A fifth of all mails refer to one id: it is found as heavy, and no lookup has its rows in one partition."""
    mail = views.headers(spark, "/root/testdata/sf0.001").limit(1000).withColumn(
        "references", F.when(F.col("uid_n") % 5 == 0, F.array(F.lit("hub@x")))
    )
    seen = []
    plain = skew.lookup

    def watched(left, right, key, right_key, by, heavy=None, how="left", salts=skew.SALTS):
        if heavy and "hub@x" in heavy:
            salted = left.where(F.col(key) == "hub@x").select(F.pmod(F.xxhash64(*by), F.lit(salts)).alias("s"))
            counts = [r["count"] for r in salted.groupBy("s").count().collect()]
            seen.append((sum(counts), max(counts)))
        return plain(left, right, key, right_key, by, heavy, how, salts)

    monkeypatch.setattr(skew, "lookup", watched)
    found = threads.reference_threads(mail, heavy_rows=50)
    assert found.count() == 1000
    assert seen and all(most < 0.2 * total for total, most in seen if total > 100)


def test_settled_labels_are_not_looked_up_again(spark, monkeypatch):
    """A chain of 32 in order: its labels are 0 to 31 steps from the end, so 30, 28, 24 and 16 are left after a jump."""
    seen = []
    plain = threads._spread_lookup

    def watched(left, right, key, *rest):
        if key == "label":
            seen.append(left.count())
        return plain(left, right, key, *rest)

    monkeypatch.setattr(threads, "_spread_lookup", watched)
    df = spark.createDataFrame([(f"{i:02d}", f"{i + 1:02d}") for i in range(31)], "a string, b string")
    found = threads.components(df, Scratch(spark, "test"))
    assert {r["node"]: r["component"] for r in found.collect()} == {f"{i:02d}": "00" for i in range(32)}
    assert seen == [31, 30, 28, 24, 16]


@pytest.mark.parametrize("slots", [1, 4, skew.SLOTS])
def test_heavy_keys_of_a_stored_table(spark, monkeypatch, slots):
    monkeypatch.setattr(skew, "SLOTS", slots)
    keys = [f"k{i % 90}" for i in range(900)] + ["hot"] * 100 + ["warm"] * 50 + [None] * 200
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    for rows, share in ((1, 0.001), (11, 0.001), (51, 0.001), (1, 0.05), (101, 0.001), (10**6, 0.001)):
        assert set(skew.heavy_keys_stored(df, "key", rows, share)) == set(skew.heavy_keys(df, "key", rows, share))


def test_ids_below_the_keys_of_messages_without_one(spark):
    """An id may begin with a control character, which sorts before those keys; names are ids all the same."""
    rows = [(0, 1, None, "\x01a@x", ["b@x"], "", None), (0, 2, None, "b@x", None, "", None), (0, 3, None, "c@x", ["d@x"], "", None),
            (0, 4, None, None, None, "", None)]
    found = {r["uid_n"]: r["thread_id"] for r in threads.reference_threads(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1] == found[2] == "\x01a@x" and found[3] == "c@x" and found[4].startswith(threads.NO_ID)
