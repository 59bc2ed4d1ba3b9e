import hashlib
import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maillake.llm import conversation_repair as cr
from maillake.llm.queries import damaged
from maillake.llm.store import scratch

SF = "/root/testdata/sf0.001"
FOLLOW = {"": "su", "s": "u", "u": "a", "a": "u"}


def faults(rows):
    """First fault of each (role, text), and the role's initial."""
    out, seen = [], set()
    for role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def cheapest(rows):
    """Least (cost, audit, repaired rows) by a search over all edits in order of cost and letters."""
    marked = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, made = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(made)
        if (i, last) in done:
            continue
        done.add((i, last))
        for role in ("user", "assistant"):
            if role[0] in FOLLOW[last]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], made + ((role, ""),)))
        if i == len(rows):
            continue
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, made))
        initial, fault = marked[i]
        if fault in ("blank", "duplicate"):
            continue
        more = 3 if fault == "truncated" else 0
        if initial and initial in FOLLOW[last]:
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, initial, made + (rows[i],)))
        for role in ("user", "assistant"):
            if role[0] in FOLLOW[last]:
                heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, role[0], made + ((role, rows[i][1]),)))


def brute(rows):
    """Per conversation what the operator should give, from (conv, turn, role, text) rows."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        plain = [(role, text) for _, role, text in own]
        turns = [t for t, _, _ in own if t is not None]
        marked = faults(plain)
        initials = [i for i, _ in marked]
        cost, audit, made = cheapest(plain)
        joined = "\n".join(f"{r}:{t}" for r, t in made)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[sum(f == name for _, f in marked) for name in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            hashlib.sha256(joined.encode()).hexdigest(),
        )
    return out


def result(found):
    """Rows of all conversations, whole ones and those put together."""
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    whole = found.whole.select("conv", *cr.COUNTED, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("sha"))
    digests = {r["conv"]: r["repaired_sha256"] for r in cr.joined_digests(found.pieces).collect()}
    out = {r["conv"]: tuple(r)[1:] for r in whole.collect()}
    for r in found.split.collect():
        assert r["conv"] not in out
        out[r["conv"]] = (*tuple(r)[1:], digests[r["conv"]])
    return out


def corpus(rng, conversations, longest):
    rows = []
    for conv in range(conversations):
        for _ in range(rng.randint(1, longest)):
            turn = rng.choice([None, *range(8)])
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "and then", " ", "", None, "Why?", "a b", f"{rng.random()}."])
            rows.append((conv if conv else None, turn, role, text))
    return rows


def test_random_conversations_equal_a_search(spark):
    rows = corpus(random.Random(5), 120, 9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert result(cr.repair(df, scratch(spark, "test"))) == brute(rows)


def test_large_conversations_are_cut_at_range_borders(spark):
    rng = random.Random(6)
    rows = corpus(rng, 4, 20) + [(7, t % 60, rng.choice(["user", "assistant"]), f"t{t}.") for t in range(250)]
    rows += [(7, 5, "user", "same.")] * 60  # many equal rows of one turn, over several ranges
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
        found = cr.repair(df, scratch(spark, "test"))
        assert found.pieces.where("conv = 7").count() > 5
        assert result(found) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pieces_of_a_range(monkeypatch):
    """A conversation larger than a piece leaves its range in bounded parts, none lost."""
    import pyarrow as pa

    monkeypatch.setattr(cr, "PIECE_ROWS", 4)
    monkeypatch.setattr(cr, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda s: 3})())}))
    n = 30
    columns = {"conv": pa.array([1] * n, pa.int64()), "turn": pa.array(range(n), pa.int64()), "role": ["user", "assistant"] * 15}
    columns |= {"text": ["x."] * n, "digest": [str(i) for i in range(n)], "kind": pa.array([1, 2] * 15, pa.int32())}
    columns |= {c: [False] * n for c in ("blank", "cut", "again")}
    batch = pa.RecordBatch.from_pydict(columns)
    rows = [r for b in cr._over_range(iter([batch.slice(0, 11), batch.slice(11)])) for r in b.to_pylist()]
    assert [r["seq"] for r in rows] == list(range(len(rows))) and sum(len(r["texts"]) for r in rows) == n
    assert max(len(r["texts"]) for r in rows) <= 4 and not any(r["whole"] for r in rows)


def test_block_tables_equal_row_by_row_costs():
    rng = np.random.default_rng(2)
    t = cr.tables()
    assert len(t.vectors) < 200 and t.vectors.min(1).max() == 0
    for _ in range(50):
        symbols = rng.integers(0, cr.SYMBOLS, 41)
        cost = cr.END
        for s in symbols[::-1]:
            cost = cr._before(cost, int(s))
        vector, total = 0, 0
        for k in range(40, 0, -cr.BLOCK):
            number = int(symbols[k - cr.BLOCK + 1 : k + 1] @ (cr.SYMBOLS ** np.arange(cr.BLOCK - 1, -1, -1)))
            total += t.added[vector, number]
            vector = t.block[vector, number]
        total_row = [c for c in cr._before(tuple(t.vectors[vector] + total), int(symbols[0]))]
        assert total_row == list(cost)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], [(1, None, None, "x" * 300_000 + ".")], [(1, 1, "user", "A.")] * 50])
def test_edge_tables_and_clashing_names(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    names = ["conv", "Digest", "kind", "again", "same", "place", "messages", "_same", "whole"]
    df = df.select("*", *[F.lit(1).alias(n) for n in names])
    assert result(cr.repair(df, scratch(spark, "test"))) == (brute(rows) if rows else {})


def test_damage(spark):
    df = spark.createDataFrame([(1, t, "assistant", "A. B!") for t in range(60)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    import zlib

    want = []
    for r in df.collect():
        key = f"{' ' if r[0] is None else r[0]}:{' ' if r[1] is None else r[1]}"
        kind, role, text = zlib.crc32(key.encode()) % 20, r[2] or " ", r[3] or " "
        if kind:
            text = "" if kind == 1 else "A B" if kind == 2 and text != " " else text
            want += [(r[0], r[1], "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    assert sorted(map(str, map(tuple, damaged(df).collect()))) == sorted(map(str, want))
