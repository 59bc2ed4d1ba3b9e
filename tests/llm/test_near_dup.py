import hashlib
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from maillake.llm import near_dup as nd
from maillake.llm.queries import QUERIES
from maillake.llm.store import scratch

from .helpers import component_names, jaccard, shingle_set

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def text_of(seed, n=200):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def edited(text, seed, times):
    rng = random.Random(seed)
    own = text.split(" ")
    for _ in range(times):
        own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
    return " ".join(own)


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA)
    return nd.classes(docs, scratch(spark, "test"), **options).collect()


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    values = np.sort(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    weights = rng.uniform(0.2, 4, 4000).astype(np.float32)
    for share in (0.3, 0.6, 0.9):
        other = weights.copy()
        cut = np.arange(4000) % 10 >= share * 10
        other[cut] = rng.uniform(0.2, 4, cut.sum())
        exact, _ = nd.similarity((values, weights), (values, other))
        agree = []
        for shift in range(12):  # other elements, so other samples
            moved = values ^ np.uint64(shift)
            both = [nd.sample(moved, w, np.array([0])) for w in (weights, other)]
            agree.append((both[0] == both[1]).mean())
        assert abs(np.mean(agree) - exact) < 0.08, (share, np.mean(agree), exact)


def test_only_frequent_shingles_are_collected(spark, monkeypatch):
    rows = [(i, text_of(i, 60) + " one phrase that all of them share") for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(40)  # few documents in each partition
    sizes, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: (sizes.append(r := collect(df)), r)[1])
    known, idf = nd.frequent_shingles(docs)
    assert max(map(len, sizes)) <= 100
    every = [v for v, _ in nd.distinct_shingles(pa.array([t for _, t in rows]))]
    values, counts = np.unique(np.concatenate(every), return_counts=True)
    assert known.tolist() == values[counts >= nd.FREQUENT * 400].tolist() and len(known) >= 3
    assert idf.min() == nd.LEAST_IDF


def test_classes_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sets = [shingle_set(t) for _, t in docs]
    links = [
        (docs[i][0], docs[j][0])
        for i in range(len(docs))
        for j in range(i)
        if sets[i] and not sets[i].isdisjoint(sets[j]) and jaccard(sets[i], sets[j]) >= nd.SIMILARITY
    ]
    names = component_names([k for k, _ in docs], links)
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op3_near_duplicates"](spark, SF).collect()}
    assert len(links) > 50 and got == names


def test_large_groups_are_one_class(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)  # both the bucket and the family path are dealt to blocks
    base = text_of(1)
    rows = [(i, base) for i in range(100)] + [(100 + i, edited(base, i, 2)) for i in range(150)]
    rows += [(1000 + i, text_of(1000 + i)) for i in range(30)]
    got = {r["doc_id"]: r["class_id"] for r in found(spark, rows)}
    assert {got[i] for i in range(250)} == {0}
    assert all(got[1000 + i] == 1000 + i for i in range(30))


def test_stars_of_one_large_family_keep_their_members(spark, monkeypatch):
    """Variants that are near to their origin only, in a family of many origins on one template, stay with it."""
    monkeypatch.setattr(nd, "BLOCK", 24)
    monkeypatch.setattr(nd, "HOT_ROWS", 50)
    template, rng, rows = text_of(50, 300).split(" "), random.Random(6), []
    for origin in range(25):
        own = list(template)
        start = rng.randrange(250)
        own[start : start + 45] = text_of(5000 + origin, 45).split(" ")
        rows.append((origin * 100, " ".join(own)))
        for k in range(1, 25):  # at 0.8 to the origin: one run of words is replaced
            other, at = list(own), rng.randrange(270)
            other[at : at + 28] = text_of(10_000 + 100 * origin + k, 28).split(" ")
            rows.append((origin * 100 + k, " ".join(other)))
    sets = {k: shingle_set(t) for k, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= nd.SIMILARITY]
    names = component_names(sets, linked)
    got = {r["doc_id"]: r["class_id"] for r in found(spark, rows)}
    lost = [(a, b) for a, b in linked if got[a] != got[b]]
    assert len(linked) > 400 and len(lost) <= 0.005 * len(linked)
    assert all(names[a] == names[b] for a in got for b in (got[a],))


def test_frequent_passages_do_not_link(spark):
    common = text_of(7, 60)
    rows = [(i, common + " " + text_of(100 + i, 100)) for i in range(120)]
    assert all(r["class_id"] == r["doc_id"] for r in found(spark, rows))


def test_frequent_counts_are_exact(spark):
    rows = [(i, "one two three four five" + (" six" if i % 50 == 0 else f" x{i}")) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    values, idf = nd.frequent_shingles(docs)
    ((first, _),) = nd.distinct_shingles(pa.array(["one two three four five"]))
    assert first[0] in values and len(values) == 2
    assert idf[list(values).index(first[0])] == pytest.approx(nd.LEAST_IDF)


def test_edge_rows(spark):
    long = text_of(3, 100000)
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "..."), (6, "a b"), (7, "A  b!"), (8, "a b c"), (9, long)]
    rows += [(10, long + " end"), (10, long + " end"), (None, "same here"), (11, "same here"), (None, "alone")]
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["class_size"]) for r in found(spark, rows))
    expected = [("1", "1", 1), ("2", "2", 1), ("3", "3", 2), ("4", "3", 2), ("5", "5", 1), ("6", "6", 2), ("7", "6", 2),
                ("8", "8", 1), ("9", "9", 3), ("10", "9", 3), ("10", "9", 3), ("11", "11", 2), ("None", "11", 2),
                ("None", "None", 1)]
    assert got == sorted(expected)
    assert found(spark, []) == []


def test_one_row_of_each_class_stays(spark):
    base = text_of(2)
    rows = [(5, base), (5, base), (3, edited(base, 1, 2)), (9, "other text"), (1, None), (1, None), (None, "")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as digest", "2 as class_id")
    kept = nd.deduplicate(docs, scratch(spark, "test"))
    assert kept.columns == docs.columns
    got = sorted(str(r["doc_id"]) for r in kept.collect())
    assert got == ["1", "1", "3", "9", "None"]


def test_rows_are_shuffled_once_and_tables_of_the_search_go(spark, plan):
    rows = [(i, text_of(i % 20)) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    tables = scratch(spark, "test")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = nd.deduplicate(docs, tables)
        shuffles = plan(kept).count("Exchange hashpartitioning")
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(20))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert shuffles == 3  # classes, rows to keep, rows
    assert [p.name for p in Path(tables.root.removeprefix("file:")).iterdir()] == ["classes"]


def test_a_crowded_bucket_loses_no_pair(spark, monkeypatch):
    """Texts that share one band only meet in no other bucket, so all members of that one have to be compared."""
    base, rng = text_of(8), np.random.default_rng(9)
    rows = [(i, edited(base, i, 1) if i < 24 else text_of(i)) for i in range(30)]
    samples = np.tile(rng.integers(1, 2**63, (1, nd.BANDS * nd.ROWS), dtype=np.uint64), (30, 1))
    samples[:, nd.ROWS :: nd.ROWS] = rng.integers(1, 2**63, (30, nd.BANDS - 1), dtype=np.uint64)
    marks = (nd.mix(samples) >> np.uint64(32)).astype(np.uint32)
    bands = nd.bands_of(samples).view(np.int64).tolist()
    signed = [(k, hashlib.md5(t.encode()).digest(), 196, b, m.tobytes()) for (k, t), b, m in zip(rows, bands, marks)]
    monkeypatch.setattr(nd, "signatures", lambda *_: spark.createDataFrame(signed, nd.SIGNATURES))
    monkeypatch.setattr(nd, "BLOCK", 4)
    monkeypatch.setattr(nd, "CENTERS", 1)
    got = {r["doc_id"]: r["class_id"] for r in found(spark, rows)}
    assert got == {i: 0 if i < 24 else i for i in range(30)}
