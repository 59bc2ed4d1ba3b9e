import hashlib
import random
import re
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maillake.llm import periodic_runs as pr
from maillake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(words):
    """All runs as (start, length, period), by comparing every word with those behind it."""
    best = {}
    for period in range(1, len(words) // 3 + 1):
        i = 0
        while i + period < len(words):
            j = i
            while j + period < len(words) and words[j] == words[j + period]:
                j += 1
            if j + period - i >= max(24, 3 * period):
                best.setdefault((i, j + period), period)
            i = max(j, i + 1)
    return sorted(((s, e - s, p) for (s, e), p in best.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def made(rng):
    kinds = rng.choice([1, 2, 3, 5, 50])
    words = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(0, 400))]
    for _ in range(rng.randint(0, 3)):
        if len(words) > 30:
            period, start = rng.randint(1, len(words) // 3), rng.randrange(len(words) - 24)
            for i in range(start + period, min(len(words), start + rng.randint(24, len(words)))):
                words[i] = words[i - period]
    if rng.random() < 0.2:  # many runs inside runs
        a, b = ["x"], ["x", "y"]
        while len(b) < len(words):
            a, b = b, b + a
        words = b[: len(words)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(1)
    texts = [made(rng) for _ in range(400)]
    column = pa.array([rng.choice([" ", "\t\n", " \x0b "]).join(t) + " " for t in texts])
    counts, runs, left = pr.judge(column)
    for i, words in enumerate(texts):
        want = brute(words)
        assert [(r["start"], r["length"], r["period"]) for r in runs[i].as_py()] == want
        assert counts[i].as_py() == len(words) and left[i].as_py() == collapsed(words, want)


@pytest.mark.parametrize("period", [7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 100, 1000])
def test_exactly_three_periods(period):
    """The shortest runs, at the borders of the scales, in any surrounding."""
    rng = random.Random(period)
    unit = [f"u{rng.randrange(4)}" for _ in range(period - 1)] + ["end"]
    length = max(24, 3 * period)
    for before in (0, 1, 5, period):
        words = [f"b{i}" for i in range(before)] + (unit * 30)[:length] + [f"a{i}" for i in range(7)]
        got = pr.judge(pa.array([" ".join(words), " ".join(words[: before + length - 1])]))[1].to_pylist()
        assert (before, length, period) in [tuple(r.values()) for r in got[0]]
        assert period not in [r["period"] for r in got[1]]


def test_a_very_long_text_and_slices(monkeypatch):
    monkeypatch.setattr(pr, "SLICE_BYTES", 1000)
    texts = ["a b c " * 20_000, None, "", "x", "y z " * 400, "one two " * 11]
    counts, runs, left = pr.judge(pa.array(texts))
    assert [len(r) for r in runs.to_pylist()] == [1, 0, 0, 0, 1, 0]
    assert left.to_pylist() == ["a b c", "", "", "x", "y z", "one two " * 10 + "one two"]
    assert counts.to_pylist() == [60_000, 0, 0, 1, 800, 22]


def test_edge_rows_and_clashing_names(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "a " * 30), (3, " \t"), (4, "ß " * 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    odd = docs.select("*", *[F.lit(9).alias(n) for n in ("Runs", "COLLAPSED", "c0", "t", "a0", "_row")])
    found = pr.find_runs(odd)
    assert [c for c in found.columns] == ["doc_id", "c0", "t", "a0", "_row", "n_words", "runs", "collapsed"]
    got = sorted((str(r["doc_id"]), r["n_words"], len(r["runs"]), r["collapsed"]) for r in found.collect())
    assert got == [("1", 0, 0, ""), ("1", 0, 0, ""), ("2", 0, 0, ""), ("3", 0, 0, ""), ("4", 24, 1, "ß"), ("None", 30, 1, "a")]
    assert pr.find_runs(odd.limit(0)).count() == 0


def test_the_query_keeps_its_contract(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_periodic_runs"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]])
        if len(words) > 4000:
            continue
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            period = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % period] for i in range(n)]
        runs = brute(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
