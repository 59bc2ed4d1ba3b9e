import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from maillake.llm import fingerprints as fp
from maillake.llm import neighbours
from maillake.llm.queries import QUERIES
from maillake.llm.store import scratch
from maillake.llm.words import column_words, shingles

SF = "/root/testdata/sf0.001"


def brute(text, fraction=fp.FRACTION):
    """All shingle hashes below the limit, and the smallest."""
    words, _ = column_words(pa.array([text or ""]))
    own = {int(h) for h in shingles(words)}
    kept = {h for h in own if h < fraction * 2**64} | ({min(own)} if own else set())
    return sorted(h - 2**64 if h >= 2**63 else h for h in kept)


def prose(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_sketches_equal_brute_force(monkeypatch):
    monkeypatch.setattr(fp, "_SLICE", 200)
    rng = random.Random(4)
    texts = [prose(rng, rng.choice([0, 1, 3, 4, 5, 6, 40, 900])) for _ in range(150)] + [None, "", "!?", "É é ß"]
    for fraction in (1 / 8, 1.0, 1e-6):
        assert fp.sketches(pa.array(texts), fraction).to_pylist() == [brute(t, fraction) for t in texts]


def test_estimates_of_unequal_texts(spark):
    """Containment of a small text in one 50 times as large, and merging without texts."""
    rng = random.Random(8)
    rows = []
    for i in range(20):
        words = prose(rng, 50_000).split()
        part = words[20_000 : 20_000 + 1000] + prose(rng, 1000).split()
        rows.append((i, " ".join(words), " ".join(part)))
    df = spark.createDataFrame(rows, "k int, text string, part string")
    both = fp.fingerprint(fp.fingerprint(df, "text", "a"), "part", "b")
    got = both.select(
        fp.containment(F.col("b"), F.col("a")), fp.likeness(F.col("a"), F.col("b")), fp.resemblance(F.col("a"), F.col("b")), fp.containment(F.col("a"), F.col("b"))
    ).collect()
    assert all(abs(r[0] - 0.5) < 0.12 and r[1] == r[0] and r[2] < 0.04 and r[3] < 0.04 for r in got)
    assert abs(np.mean([r[0] for r in got]) - 0.5) < 0.03
    whole = {tuple(r["a"]) for r in both.select("a").collect()}
    least = min(min(x % 2**64 for x in s) for s in whole)
    want = {x for s in whole for x in s if x % 2**64 < 2**61 or x % 2**64 == least}
    assert set(both.agg(fp.merged("a").alias("m")).first()["m"]) == want
    smaller = both.select(fp.reduced(F.col("a"), 1 / 64).alias("s"), "a").first()
    assert smaller["s"] == [x for x in smaller["a"] if x % 2**64 < 2**58]


def test_edge_rows_and_clashing_names(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "a"), (None, "a"), (4, "word " * 200_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(1).alias(n) for n in ("Sketch", "c0", "T", "a0")])
    got = {(r["doc_id"], len(r["sketch"])) for r in fp.fingerprint(odd).collect()}
    assert got == {(1, 0), (2, 0), (3, 1), (None, 1), (4, 1)}
    assert fp.fingerprint(odd.limit(0)).count() == 0
    empty, some = F.array().cast("array<long>"), F.array(F.lit(5).cast("long"))
    told = spark.range(1).select(fp.likeness(empty, empty), fp.likeness(empty, some), fp.likeness(some, some)).first()
    assert tuple(told) == (1.0, 0.0, 1.0)


def followed(rows):
    """(key, text, next text) by a walk in order of key; rows of one key must be equal."""
    own = sorted(((k is not None, k or 0), t or "") for k, t in rows)
    return [(k[1] if k[0] else None, t, own[(i + 1) % len(own)][1]) for i, (k, t) in enumerate(own)]


def test_next_rows(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(10**9), f"t{i}") for i in range(400)] + [(-5, "low"), (2**62, "high"), (7, None)]
    rows += [(11, "same")] * 300 + [(None, "none")] * 100  # a key with a third of all rows
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _range", "2 as next_text").repartition(6)
    got = [tuple(r) for r in neighbours.with_next(df, "doc_id", "text", scratch(spark, "test")).collect()]
    assert sorted(got, key=str) == sorted(followed(rows), key=str)
    one = spark.createDataFrame([(3, "x")], "doc_id int, text string")
    assert [tuple(r) for r in neighbours.with_next(one, "doc_id", "text", scratch(spark, "test")).collect()] == [(3, "x", "x")]
    assert neighbours.with_next(one.limit(0), "doc_id", "text", scratch(spark, "test")).count() == 0


def test_hot_rows_are_spread_over_ranges(spark):
    df = spark.range(4000).selectExpr("if(id % 2 = 0, 7, id) as doc_id", "if(id % 2 = 0, 'same', 't' || id) as text")
    rows = df.select(*neighbours._place(F.col("doc_id"), F.col("text")))
    bounds = neighbours.borders(rows.repartition(4), 16, scratch(spark, "test"))
    assert sum(b[1] == 7 for b in bounds) >= 4 and len(bounds) >= 12


def test_the_query_keeps_its_contract(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = {r["doc_id"]: r for r in QUERIES["op13_fingerprints"](spark, SF).collect()}
    assert len(rows) == len(docs)

    def alike(a, b):
        a, b = set(brute(a)), set(brute(b))
        return 1.0 if not a and not b else len(a & b) / min(len(a), len(b)) if a and b else 0.0

    for i, (key, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[key]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{h % 2**64:016X}" for h in brute(text))
        assert r["edited_fingerprint"] == "".join(f"{h % 2**64:016X}" for h in brute(edited))
        assert (r["near_edited"], r["near_next"]) == (alike(text, edited), alike(text, after))
