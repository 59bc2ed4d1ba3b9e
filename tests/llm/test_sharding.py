import zlib

import numpy as np

from maillake.llm import sharding as sh
from maillake.llm.queries import QUERIES, sharded

SF = "/root/testdata/sf0.01"


def test_the_query_keeps_its_contract(spark):
    rows = QUERIES["op8_sharding"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    size, places = np.zeros(24), {}
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        size[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert len(places) == 24 and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert size.max() < 1.02 * size.min()


def test_rebalance_moves_little_and_ends_even():
    rng = np.random.default_rng(3)
    loads = rng.lognormal(10, 1.5, sh.SLOTS).astype(np.int64)
    first = sh.dealt(24)
    second = sh.rebalance(first, loads, 24)
    held = np.bincount(second, weights=loads)
    assert held.max() - held.min() < 0.001 * held.mean() and (first != second).mean() < 0.2
    third = sh.grow(second, loads, 24)
    moved = third != second
    assert (third[moved] == 24).all() and abs(np.bincount(third, weights=loads)[24] / loads.sum() - 1 / 25) < 0.002
    assert (sh.rebalance(second, loads, 24) == second).mean() > 0.99


def test_versions_of_the_map(spark, tmp_path):
    folder = str(tmp_path / "map")
    for version in range(2):
        sh.save_map(spark, folder, np.full(16, version), version)
    assert {r["shard"] for r in sh.load_map(spark, folder, 0).collect()} == {0}
    assert {r["shard"] for r in sh.load_map(spark, folder, 1).collect()} == {1}


def test_edge_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "a"), (None, "b"), (3, "x" * 10**6), (4, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as virtual_slot", "3 as _rank")
    got = sharded(spark, docs, 3).collect()
    assert len(got) == len(rows) and {r["size"] for r in got} == {8, 9, 10**6 + 8}
    for shard in range(3):
        own = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert sharded(spark, docs.limit(0), 3).count() == 0
