from fractions import Fraction

import pytest

from pyspark.sql import functions as F

from maillake.llm import mixing
from maillake.llm.queries import QUERIES
from maillake.llm.store import scratch

SF = "/root/testdata/sf0.01"


def waterfill(sizes):
    """Share by weight, cut at three times the size, share the rest again, exactly."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    full, open_ = {}, set(names)
    left = Fraction(sum(sizes.values()))
    while open_:
        total = sum(weight[n] for n in open_)
        over = [n for n in open_ if left * weight[n] / total > 3 * sizes[n]]
        if not over:
            return full | {n: left * weight[n] / total for n in open_}
        for n in over:
            full[n] = Fraction(3 * sizes[n])
            open_.discard(n)
        left = Fraction(sum(sizes.values())) - sum(full.values())
    return full


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 20, "c": 30, None: 5}, {"a": 1, "b": 1000}, {"z": 1}, {None: 7, "": 3, "é": 1, "zz": 100, "Z": 1},
    {f"s{i}": (i * 37) % 101 for i in range(50)}, {"a": 0, "b": 0}, {"a": 0, "b": 4, "c": 9},
])
def test_targets_against_exact_sharing(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    got = mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()
    expected = waterfill(sizes)
    assert {r["source"] for r in got} == set(sizes)
    for r in got:
        assert r["target"] == pytest.approx(float(expected[r["source"]]), rel=1e-12, abs=1e-9)


def test_the_query_keeps_its_contract(spark):
    rows = QUERIES["op1_mixing"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(rows)))
    again = QUERIES["op1_mixing"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    taken, target = {}, {}
    for r in rows:
        assert r["size"] == len(docs[r["doc_id"]]["text"].split()) or not docs[r["doc_id"]]["text"].isascii()
        assert r["taken"] <= 3 * r["size"]
        source = docs[r["doc_id"]]["source"]
        taken[source] = taken.get(source, 0) + r["taken"]
        target[source] = r["target"]
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in rows))
    assert sum(taken.values()) == pytest.approx(sum(target.values()), rel=0.03)
    for source, words in taken.items():
        assert words == pytest.approx(target[source], rel=0.1)


def test_emitted_copies(spark):
    rows = [(i, f"w{i} " * (i % 5 + 1), "s" if i % 3 else None) for i in range(300)]
    rows += [(1000, None, "s"), (1001, "", "t"), (None, "x y", "s"), (7, rows[7][1], rows[7][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'c' as copies", "1 as _key2")
    planned = mixing.plan(mixing.measure(docs), scratch(spark, "test")).collect()
    out = mixing.mix(docs, scratch(spark, "test"))
    assert out.columns == docs.columns
    counts = {}
    for r in out.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    expected = {}
    for r in planned:
        expected[r["doc_id"]] = expected.get(r["doc_id"], 0) + r["copies"]
    assert counts == {k: n for k, n in expected.items() if n}
    assert mixing.mix(docs.limit(0), scratch(spark, "test")).count() == 0


def test_native_only(spark, plan):
    text = plan(mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), scratch(spark, "test")))
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_columns_named_like_inner_ones_are_kept(spark):
    names = ["_seed", "_KEY", "_id", "_row", "_source_key", "Rate", "weight", "_words", "copy_", "_salt"]
    docs = spark.createDataFrame([(1, "a b c", "s"), (2, "d e", None)], "doc_id long, text string, source string")
    odd = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    planned = mixing.plan(mixing.measure(odd), scratch(spark, "test"))
    assert [c for c in planned.columns if c in names] == [n for n in names if n.lower() not in mixing.PLANNED]
    assert sorted(r["_seed"] for r in planned.collect()) == [0, 0]
    assert mixing.mix(odd, scratch(spark, "test")).columns == odd.columns
