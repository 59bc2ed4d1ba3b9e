"""Thread roots against a direct walk."""

from __future__ import annotations

import random

import pytest

from maillake.operators import reply_chains

SCHEMA = "mailbox_ord int, uid_n long, message_id string, in_reply_to string, references array<string>"


def walked(rows, mode):
    """Roots by walking, written from the description of the rule."""
    index = {}
    for row in sorted(rows):
        if row[2]:
            index[row[2]] = row
    roots = {}
    for order, uid, own, parent, refs in rows:
        key = (order, uid)
        if refs:
            roots[key] = refs[0]
            continue
        if parent is None:
            roots[key] = own if mode == "ancestor" else None
            continue
        seen, current, root = set(), parent, None
        while current is not None and current not in seen:
            seen.add(current)
            if current not in index:
                root = current
                break
            _, _, _, above, above_refs = index[current]
            if above_refs:
                root = above_refs[0]
                break
            if above is None:
                root = current if mode == "ancestor" else None
                break
            current = above
        roots[key] = root
    return roots


def found(spark, rows, mode, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    out = reply_chains.thread_roots(df, mode, **options).collect()
    assert len(out) == len(rows)
    return {(r["mailbox_ord"], r["uid_n"]): r for r in out}


CASES = [
    (0, 1, "a", None, ["r1", "r2"]),
    (0, 2, "b", "u", []),
    (0, 3, "t", None, []),
    (0, 4, "c", "t", []),
    (0, 5, "d", "a", []),
    (0, 6, "e", "f", []),
    (0, 7, "f", "e", []),
    (0, 8, "g", "e", []),
    (0, 9, None, None, []),
    (0, 10, None, "c", []),
    (0, 11, "self", "self", []),
    (0, 12, "dup", "t", []),
    (1, 12, "dup", "u2", []),
    (0, 13, "h", "dup", []),
]


@pytest.mark.parametrize("mode", reply_chains.MODES)
def test_cases(spark, mode):
    rows = found(spark, CASES, mode)
    assert {k: r["root_message_id"] for k, r in rows.items()} == walked(CASES, mode)


def test_expected_roots(spark):
    exact = {k[1]: r["root_message_id"] for k, r in found(spark, CASES, "exact").items() if k[0] == 0}
    assert (exact[1], exact[2], exact[3], exact[4], exact[5], exact[6], exact[13]) == ("r1", "u", None, None, "r1", None, "u2")
    above = {k[1]: r for k, r in found(spark, CASES, "ancestor").items() if k[0] == 0}
    assert above[4]["root_message_id"] == "t" and above[4]["reply_depth"] == 1
    assert above[10]["root_message_id"] == "t" and above[10]["reply_depth"] == 2
    assert above[3]["root_message_id"] == "t" and above[3]["reply_depth"] == 0
    assert above[9]["root_message_id"] is None and above[6]["root_message_id"] is None


def random_corpus(seed, n=1500):
    rng = random.Random(seed)
    rows = []
    for uid in range(n):
        kind = rng.random()
        own = None if kind < 0.05 else f"m{uid if kind > 0.1 else rng.randrange(n)}"
        pick = rng.random()
        if pick < 0.15:
            parent = None
        elif pick < 0.2:
            parent = f"gone{rng.randrange(20)}"
        elif pick < 0.5:
            parent = "m7"
        else:
            parent = f"m{uid - 1}" if uid else None
        rows.append((rng.randrange(2), uid, own, parent, [f"ref{uid % 5}"] if rng.random() < 0.03 else []))
    # A long chain, a long cycle, and a chain into the cycle.
    rows += [(0, 5000 + i, f"chain{i}", f"chain{i - 1}" if i else None, []) for i in range(150)]
    rows += [(0, 6000 + i, f"ring{i}", f"ring{(i + 1) % 60}", []) for i in range(60)]
    rows += [(0, 7000 + i, f"tail{i}", f"tail{i - 1}" if i else "ring3", []) for i in range(20)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("mode, heavy", [("exact", 50), ("ancestor", 1_000_000)])
def test_random_corpora(spark, mode, heavy):
    """With ``heavy_rows=50`` the much-answered message takes the salted path."""
    rows = random_corpus(len(mode))
    got = found(spark, rows, mode, heavy_rows=heavy)
    assert {k: r["root_message_id"] for k, r in got.items()} == walked(rows, mode)


def test_last_row_wins(spark):
    df = spark.createDataFrame(CASES, SCHEMA)
    index = {r["message_id"]: r for r in reply_chains.message_index(df).collect()}
    assert index["dup"]["in_reply_to"] == "u2" and None not in index and len(index) == 11


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        reply_chains.thread_roots(spark.createDataFrame(CASES, SCHEMA), "other")
