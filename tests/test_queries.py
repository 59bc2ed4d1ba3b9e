"""Every registered query beside its SQL at the smallest scale."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
import verify
from checks import registry
from conftest import SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    good, note = verify.compare(spark, duck, SF, name)
    assert good, note


def test_every_query_has_sql():
    assert set(registry.SQL) == set(registry.QUERIES)
    assert set(registry.QUERIES) <= set(contract.queries()) and set(registry.SQL) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize(
    "name",
    ["normalize_addresses", "pair_conversations", "session_ids", "participants", "fallback_conversations", "canonical_subjects", "date_buckets", "limit_per_mailbox", "message_index"],
)
def test_no_python_in_built_in_queries(spark, plan, name):
    text = plan(contract.queries()[name](spark, SF))
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
