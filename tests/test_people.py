"""Roles, conversation ids, CRM look-up."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from maillake.functions.conversation import unordered_pair_id
from maillake.operators import enrich, people, skew

AGENCY = ["agency.example"]
ROW = "uid string, mailbox string, `from` struct<name:string,email:string>, to array<struct<name:string,email:string>>, cc array<struct<name:string,email:string>>, bcc array<struct<name:string,email:string>>"

CUST, AGENT = "cust@shop.example", "agent@agency.example"
# sender, recipients, customer, agent, pair
CASES = [
    (CUST, [AGENT], CUST, AGENT, (CUST, AGENT)),
    (AGENT, ["bad", CUST], CUST, AGENT, (CUST, AGENT)),
    ("bad", [CUST, AGENT], None, AGENT, None),
    ("", [CUST, AGENT], CUST, AGENT, (CUST, AGENT)),
    ("a@agency.example", ["b@agency.example"], None, "a@agency.example", ("a@agency.example", "b@agency.example")),
    ("alice@a.example", ["bob@b.example"], "alice@a.example", None, ("alice@a.example", "bob@b.example")),
    ("x@sub.agency.example", [AGENT], "x@sub.agency.example", AGENT, ("x@sub.agency.example", AGENT)),
    (CUST, [], CUST, None, None),
    ("bad@agency.example@x", [CUST], None, None, None),
    ("inv alid@agency.example", [AGENT, CUST], CUST, None, None),
]


def headers(spark, cases):
    rows = [
        (str(i), "INBOX", ("", sender), [("", r) for r in to[:1]], [("", r) for r in to[1:]], None)
        for i, (sender, to, *_) in enumerate(cases)
    ]
    return spark.createDataFrame(rows, ROW)


def test_roles(spark):
    found = {r["uid"]: r for r in people.with_roles(headers(spark, CASES), AGENCY).collect()}
    for i, (_, _, customer, agent, pair) in enumerate(CASES):
        row = found[str(i)]
        assert (row["customer_email_normalized"], row["agent_email"]) == (customer, agent), i
        want = None
        if pair:
            want = spark.range(1).select(unordered_pair_id(F.lit(pair[0]), F.lit(pair[1])).alias("p")).first()["p"]
        assert row["conversation_id"] == want, i


def test_no_agency_domains(spark):
    row = people.with_roles(headers(spark, CASES[:1]), []).first()
    assert (row["customer_email_normalized"], row["agent_email"]) == (CUST, None)
    assert row["conversation_id"] is not None


def test_plan_has_no_python_and_one_pass(spark, plan):
    found = people.with_roles(headers(spark, CASES), AGENCY).where("conversation_id is not null")
    text = plan(found)
    assert "Python" not in text and "Arrow" not in text
    # The filter did not drag a second copy of the address pipeline along.
    assert text.count("googlemail.com") == 1


def test_participants(spark):
    rows = [("1", "INBOX", ("", " B@x.com "), [("", "a@x.com"), ("", "")], [("", "b@X.com")], None)]
    assert people.with_participants(spark.createDataFrame(rows, ROW)).first()["participants"] == ["a@x.com", "b@x.com"]


def crm(spark):
    return spark.createDataFrame([(CUST, "C1"), ("alice@a.example", "")], "email string, customer_id string")


@pytest.mark.parametrize("limit", [skew.BROADCAST_BYTES, 0])
def test_crm(spark, plan, limit):
    keyed = people.with_roles(headers(spark, CASES), AGENCY)
    joined = enrich.with_customer_id(keyed, crm(spark), "acme", ("mailbox", "uid"), limit)
    if limit:
        assert "BroadcastHashJoin" in plan(joined)
    found = {r["uid"]: r for r in joined.collect()}
    assert len(found) == len(CASES)
    assert found["0"]["customer_id"] == "C1" and found["0"]["session_id"]
    assert found["5"]["customer_id"] == "" and found["5"]["session_id"] is None
    assert found["6"]["customer_id"] == "x@sub.agency.example" and found["6"]["session_id"]
    assert found["2"]["customer_id"] is None and found["2"]["session_id"] is None


def test_headers_win_as_a_whole(spark):
    fields = "mailbox string, uid string, message_id string, in_reply_to string, references array<string>, subject string, subject_canonical string, `from` struct<name:string,email:string>, to array<struct<name:string,email:string>>, cc array<struct<name:string,email:string>>, bcc array<struct<name:string,email:string>>, date_header string, date_utc string"
    full = spark.createDataFrame([("m", u, f"id{u}", "r", ["x"], "full", "full", ("", ""), [], [], [], "d", "d") for u in "12"], fields)
    head = spark.createDataFrame([("m", u, None, None, [], "head", "head", ("", ""), [], [], [], None, None) for u in "13"], fields)
    found = {r["uid"]: r for r in enrich.with_headers(full, head).collect()}
    assert sorted(found) == ["1", "2"]
    assert (found["1"]["subject"], found["1"]["message_id"], found["1"]["date_utc"]) == ("head", None, None)
    assert (found["2"]["subject"], found["2"]["message_id"]) == ("full", "id2")


def test_lookup_spreads_heavy_and_missing_keys(spark):
    left = spark.range(4000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then null else 'k' || id end as key")
    right = spark.range(4000).selectExpr("'k' || id as rk", "id * 2 as v").unionByName(spark.sql("select 'hot' as rk, -1L as v"))
    assert skew.heavy_keys(left, "key", rows=1000) == ["hot"]
    assert skew.heavy_keys(left, "key") == []
    joined = skew.lookup(left, right, "key", "rk", ["id"], ["hot"])
    assert joined.columns == ["id", "key", "v"]
    rows = {r["id"]: r["v"] for r in joined.collect()}
    assert len(rows) == 4000
    assert all(rows[i] == (-1 if i % 3 == 0 else None if i % 3 == 1 else i * 2) for i in rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        wide = skew.lookup(left, right, "key", "rk", ["id"], ["hot"])
        largest = wide.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert wide.count() == 4000 and largest < 1500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_inner_lookup_keeps_every_heavy_row(spark):
    left = spark.range(500).selectExpr("id", "if(id < 400, 'hot', 'cold') as key")
    right = spark.createDataFrame([("hot", 1), ("cold", 2)], "rk string, v int")
    joined = skew.lookup(left, right, "key", "rk", ["id"], ["hot"], "inner", salts=7)
    assert joined.count() == 500 and joined.agg(F.sum("v")).first()[0] == 600


def test_measured_bytes_is_an_upper_estimate(spark):
    df = spark.createDataFrame([("a" * 100, "b" * 50), (None, "é")], "x string, y string")
    assert skew.measured_bytes(df) >= 100 + 50 + 2
    assert skew.measured_bytes(df.limit(0)) == 0
    lists = spark.createDataFrame([(["c" * 70, "d" * 30],)], "x array<string>")
    assert skew.measured_bytes(lists) >= 100


def test_a_large_map_looks_at_the_messages_twice(spark):
    """Once for the addresses that are asked for, once for the result."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(str(i), "INBOX", f"c{i % 7}@x.example" if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "uid string, mailbox string, customer_email_normalized string")
    crm_map = spark.createDataFrame([(f"c{i}@x.example", f"C{i}") for i in range(0, 40, 2)], "email string, customer_id string")
    got = enrich.with_customer_id(df.mapInArrow(count, df.schema), crm_map, "acme", broadcast_bytes=0).collect()
    want = {u: None if e is None else f"C{e[1]}" if int(e[1]) % 2 == 0 else e for u, _, e in rows}
    assert {r["uid"]: r["customer_id"] for r in got} == want and len(got) == 200
    assert seen.value <= 400


def test_heavy_counts(spark):
    counts = spark.createDataFrame([("hot", 5000), ("cold", 3)], "key string, n long")
    assert skew.heavy_counts(counts, "key", "n", rows=1000) == ["hot"] and skew.heavy_counts(counts, "key", "n") == []
    assert skew.heavy_counts(counts.limit(0), "key", "n") == []
