"""Readers, writers and the whole export."""

from __future__ import annotations

import json
import logging
import time

import pytest
from pyspark.sql import functions as F

from maillake import schemas
from maillake.operators import lineage
from maillake.plans.export import ExportJob, in_order, run_timestamp, to_export
from maillake.plans.profile import mailbox_profile
from maillake.sources import messages, side_inputs, sinks


def message(n, sender="cust@shop.example", to="agent@agency.example"):
    return f"From: {sender}\r\nTo: {to}\r\nSubject: Re: é {n}\r\nMessage-ID: <m{n}@x>\r\n\r\nhi {n}".encode()


ATTACHED = (
    b'Content-Type: multipart/mixed; boundary="b"\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\nhello\r\n'
    b'--b\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename="a/b.pdf"\r\n\r\none\r\n'
    b"--b\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment\r\n\r\ntwo\r\n--b--\r\n"
)


@pytest.fixture
def landed(tmp_path):
    """Single-file messages: two mailboxes, one message that cannot be read."""
    root = tmp_path / "landing"
    for box, uids in {"INBOX": range(1, 6), "Sent": range(10, 12)}.items():
        folder = root / f"mailbox={box}"
        folder.mkdir(parents=True)
        for uid in uids:
            ends = ("cust@shop.example", "agent@agency.example")
            (folder / f"{uid}.eml").write_bytes(message(uid, *(ends[::-1] if box == "Sent" else ends)))
    (root / "mailbox=INBOX" / "3.eml").write_bytes(b"To: a@[\r\n\r\nx")
    (root / "mailbox=INBOX" / "4.eml").write_bytes(b"From: cust@shop.example\r\nMIME-Version: 1.0\r\n" + ATTACHED)
    return str(root)


def test_read_eml(spark, landed):
    raw = messages.read_raw(spark, landed, "eml")
    rows = {(r["mailbox"], r["uid"], r["uid_n"]) for r in raw.collect()}
    assert rows == {("INBOX", str(u), u) for u in range(1, 6)} | {("Sent", "10", 10), ("Sent", "11", 11)}
    with pytest.raises(ValueError):
        messages.read_raw(spark, landed, "other")


def test_mailbox_filter_prunes_folders(spark, landed, plan):
    text = plan(messages.read_raw(spark, landed, "eml").where("mailbox = 'Sent'"))
    assert "PartitionFilters: [isnotnull(mailbox" in text


def test_headers_are_cut_before_parsing(spark, landed):
    cut = messages.read_headers(spark, landed, "eml").where("uid = 1").first()
    assert bytes(cut["content"]).endswith(b"\r\n\r\n")


def test_read_mailboxes(spark, landed, caplog):
    with caplog.at_level(logging.ERROR, "maillake"):
        chosen = messages.read_mailboxes(spark, landed, ["Sent", "Nowhere", "INBOX", "Sent"], "eml", limit=1)
    assert "Nowhere" in caplog.text
    assert sorted((r["mailbox_ord"], r["mailbox"], r["uid"]) for r in chosen.collect()) == [
        (0, "Sent", "10"), (2, "INBOX", "1"), (3, "Sent", "10"),
    ]


def test_union_mailboxes(spark):
    part = spark.createDataFrame([("a", 1)], "mailbox string, uid_n long")
    whole = messages.union_mailboxes([part, part])
    assert sorted(r["mailbox_ord"] for r in whole.collect()) == [0, 1]
    with pytest.raises(ValueError):
        messages.union_mailboxes([])


def test_decode_fetch_prefix(spark):
    texts = [
        "1 (UID 12 FLAGS (\\Seen  $A\t$B) X-GM-THRID 99 RFC822 {3}",
        "2 (UID  13 FLAGS () RFC822 {3}",
        "3 (FLAGS (x) RFC822 {3}",
        "4 (UID 14 RFC822 {3}",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "prefix string")
    rows = messages.decode_fetch_prefix(df).orderBy("uid").collect()
    assert [(r["uid"], r["flags"], r["provider_thread_id"]) for r in rows] == [
        ("12", ["\\Seen", "$A", "$B"], "99"), ("13", [], None), ("14", [], None),
    ]


def crm_file(tmp_path, text):
    path = tmp_path / "crm.json"
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize(
    "text, want",
    [
        ('{\n"a@x.com": "1", "b": 2, "c": null, "d": ["q"], "e": "", "a@x.com": "3", "t": true}', {"a@x.com": "3", "e": ""}),
        ('["a"]', {}),
        ('{"a": "x"', {}),
        ("", {}),
    ],
)
def test_crm_map(spark, tmp_path, text, want):
    rows = side_inputs.read_crm_map(spark, crm_file(tmp_path, text)).collect()
    assert {r["email"]: r["customer_id"] for r in rows} == want


def test_crm_map_missing_and_tables(spark, tmp_path, caplog):
    with caplog.at_level(logging.WARNING, "maillake"):
        assert side_inputs.read_crm_map(spark, str(tmp_path / "none.json")).count() == 0
    assert "none.json" in caplog.text
    assert side_inputs.read_crm_map(spark, " ").count() == 0
    table = spark.createDataFrame([("a", "1")], "email string, customer_id string")
    table.write.parquet(str(tmp_path / "crm.parquet"))
    table.write.json(str(tmp_path / "crm.ndjson"))
    for form in ("parquet", "ndjson"):
        assert [tuple(r) for r in side_inputs.read_crm_map(spark, str(tmp_path / f"crm.{form}"), form).collect()] == [("a", "1")]
    with pytest.raises(ValueError):
        side_inputs.read_crm_map(spark, "x", "other")


def test_ndjson_lines(spark, tmp_path):
    row = {name: None for name in schemas.EXPORT_FIELDS}
    row |= {"uid": "1", "mailbox": "é", "to": [], "from": ("", ""), "attachments": [("f", "t", 1, "s", None, None)]}
    df = spark.createDataFrame([tuple(row[n] for n in schemas.EXPORT_FIELDS)], schemas.EXPORT)
    sinks.write_ndjson(df, str(tmp_path / "out"), single_file=True)
    (line,) = (tmp_path / "out").glob("*.json")
    text = line.read_text(encoding="utf-8").strip()
    record = json.loads(text)
    assert tuple(record) == schemas.EXPORT_FIELDS and '"mailbox":"é"' in text
    assert record["message_id"] is None and record["attachments"][0]["saved_path"] is None
    assert sinks.read_ndjson(spark, str(tmp_path / "out")).first() == df.first()


@pytest.mark.parametrize("out_form", ["ndjson", "parquet"])
def test_export_job(spark, tmp_path, landed, out_form):
    job = ExportJob(
        raw_path=landed, raw_form="eml", out_path=str(tmp_path / "out"), out_form=out_form, mailboxes=["INBOX", "Sent", "INBOX"],
        agency_domains="agency.example", tenant="acme", crm_path=crm_file(tmp_path, '{"cust@shop.example": "C1"}'),
        attachments_dir=str(tmp_path / "files"), fetch_ts_utc="2024-02-01T00:00:00Z",
    )
    counts = {r["mailbox"]: r["messages"] for r in job.run(spark).collect()}
    assert counts == {"INBOX": 8, "Sent": 2}
    bad = spark.read.parquet(str(tmp_path / "out" / "quarantine")).collect()
    assert {(r["mailbox"], r["uid"], r["stage"]) for r in bad} == {("INBOX", "3", "headers")} and len(bad) == 2
    target = str(tmp_path / "out" / "messages")
    written = sinks.read_ndjson(spark, target) if out_form == "ndjson" else spark.read.parquet(target)
    rows = {(r["mailbox"], r["uid"]): r for r in written.collect()}
    first, sent, attached = rows["INBOX", "1"], rows["Sent", "10"], rows["INBOX", "4"]
    assert first["subject"] == "Re: é 1" and first["subject_canonical"] == "é 1" and first["body_text"] == "hi 1"
    assert first["conversation_id"] == sent["conversation_id"] and first["customer_id"] == "C1" and first["session_id"]
    assert first["fetch_ts_utc"] == "2024-02-01T00:00:00Z" and first["flags"] == [] and first["provider_thread_id"] is None
    assert sent["customer_email_normalized"] == "cust@shop.example" and sent["session_id"] == first["session_id"]
    paths = [a["saved_path"] for a in attached["attachments"]]
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a_b_4_3.pdf", "attachment_INBOX_4_4_4_4"]
    assert len({p.rsplit("/", 2)[1] for p in paths}) == 1 and paths[0].rsplit("/", 2)[1].startswith("INBOX-")
    assert [open(p, "rb").read() for p in paths] == [b"one", b"two"]


def test_attachment_folder_that_cannot_be_written(spark, tmp_path, landed):
    blocked = tmp_path / "blocked"
    blocked.write_text("a file, not a folder")
    job = ExportJob(landed, str(tmp_path / "out"), ["INBOX"], raw_form="eml", attachments_dir=str(blocked))
    assert job.run(spark).first()["messages"] == 4
    row = sinks.read_ndjson(spark, str(tmp_path / "out" / "messages")).where("uid = '4'").first()
    assert [a["saved_path"] for a in row["attachments"]] == [None, None]


def test_export_takes_flags_and_thread_along(spark, landed):
    from maillake.operators import mime

    raw = messages.read_raw(spark, landed, "eml").where("uid = '1'").withColumns(
        {"flags": F.array(F.lit("\\Seen")), "provider_thread_id": F.lit("77"), "mailbox_ord": F.lit(0)}
    )
    crm = side_inputs.read_crm_map(spark, None)
    out = to_export(mime.parse_messages(raw), crm, ["agency.example"])
    row = in_order(out).first()
    assert row["flags"] == ["\\Seen"] and row["provider_thread_id"] == "77"
    assert row["customer_id"] == "cust@shop.example" and row["fetch_ts_utc"].endswith("Z")
    assert run_timestamp().endswith("Z")


def test_export_takes_the_headers_of_an_earlier_pass(spark, landed):
    from maillake.operators import mime

    raw = messages.read_raw(spark, landed, "eml").where("mailbox = 'INBOX'").withColumn("mailbox_ord", F.lit(0))
    parsed = mime.parse_messages(raw).where("error is null")
    crm = side_inputs.read_crm_map(spark, None)
    alone = {r["uid"]: r for r in to_export(parsed, crm, ["agency.example"]).collect()}
    box = F.struct(F.lit("").alias("name"), F.lit("other@shop.example").alias("email"))
    earlier = mime.parse_headers(raw).where("uid = '1'").withColumns({"subject": F.lit("earlier"), "from": box, "date_utc": F.lit(None).cast("string")})
    gone = earlier.withColumn("uid", F.lit("99"))
    out = to_export(parsed, crm, ["agency.example"], headers=earlier.unionByName(gone).unionByName(earlier)).collect()
    got = {r["uid"]: r for r in out}
    assert len(out) == len(alone) and got.keys() == alone.keys()
    one = got.pop("1")
    assert (one["subject"], one["customer_id"], one["date_utc"]) == ("earlier", "other@shop.example", None)
    assert one["body_text"] == alone["1"]["body_text"] and one["conversation_id"] not in (None, alone["1"]["conversation_id"])
    same = [f for f in schemas.EXPORT_FIELDS if f != "fetch_ts_utc"]
    assert all(r[f] == alone[uid][f] for uid, r in got.items() for f in same)


def test_records_are_written_in_order_as_lines_and_read_back(spark, tmp_path):
    from checks import mime as queries

    pages = [(i, f"https://a.example/{i}", f"<p>page {i}</p>") for i in (12, 3, 21, 4, 1, 10, 2, 8, 7)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(2,), (3,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    out = queries.export_records(spark, str(tmp_path))
    files = sorted(f.removeprefix("file://") for f in out.inputFiles())
    lines = [json.loads(line) for f in files for line in open(f, encoding="utf-8")]
    assert all(list(line) == list(schemas.EXPORT_FIELDS) for line in lines)
    places = {"INBOX": 0, "INBOX.Sent": 1, "Archive": 2}
    order = [(places[line["mailbox"]], int(line["uid"][1:]), line["uid"]) for line in lines]
    assert order == sorted(order) and len(order) > len(pages)
    assert {(r["uid"], r["subject"], r["fields"]) for r in out.collect()} == {(line["uid"], line["subject"], 23) for line in lines}


def test_profile_plan(spark, landed):
    counts, summary = mailbox_profile(spark, landed, ["INBOX", "None"], "eml")
    assert {r["mailbox"]: r["messages"] for r in counts.collect()} == {"INBOX": 5, "None": -1}
    assert tuple(summary.first()) == (2, "INBOX,None")
    counts, summary = mailbox_profile(spark, landed, form="eml")
    assert {r["mailbox"]: r["messages"] for r in counts.collect()} == {"INBOX": 5, "Sent": 2}
    assert tuple(summary.first()) == (2, "INBOX,Sent")


class FakeSession:
    """Only the configuration of a session; spark.checkpoint.dir of a real one cannot be changed."""

    def __init__(self, **conf):
        self.values = conf
        self.conf = self

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        assert not key.startswith("spark.")
        self.values[key] = value


def test_shared_folder_is_the_clusters():
    cluster = {"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://name/check/"}
    assert lineage.shared_folder(FakeSession(**cluster)) == "hdfs://name/check"
    with pytest.raises(RuntimeError):
        lineage.shared_folder(FakeSession(**{"spark.master": "yarn"}))
    local = FakeSession(**{"spark.master": "local[4]"})
    assert lineage.shared_folder(local) == lineage.shared_folder(local)


def test_scratch_tables(spark):
    scratch = lineage.Scratch(spark, "job")
    assert scratch.root.startswith(lineage.shared_folder(spark))
    assert scratch.write(spark.range(3), "t").count() == 3
    rounds = lineage.Rounds(scratch, "rounds")
    rounds.add(spark.range(4).selectExpr("id", "id < 2 as done"))
    assert rounds.open().count() == 2 and rounds.state().count() == 4
    rounds.add(rounds.open().selectExpr("id", "id < 3 as done"))
    assert [r["id"] for r in rounds.open().collect()] == [3]
    assert sorted(r["id"] for r in rounds.state().collect()) == [0, 1, 2, 3]


def test_places_of_lines_are_found_from_a_row_per_piece(spark, plan):
    from checks.mime import placed

    rows = [("b", 0, 7), ("b", 0, 8), ("a", 100, 0), ("a", 0, 1 << 33), ("a", 0, (1 << 33) + 1), ("a", 100, 1)]
    lines = spark.createDataFrame(rows, "_file string, _from long, _at long").repartition(3)
    got = {(r["_file"], r["_from"], r["_at"]): r["place"] for r in placed(lines).collect()}
    assert [got[k] for k in sorted(rows)] == [1, 2, 3, 4, 5, 6]
    text = plan(placed(lines))
    assert text.index("BroadcastExchange") < text.index("Exchange SinglePartition") and text.count("SinglePartition") == 1


def test_messages_of_the_queries_are_computed_once(spark, plan, monkeypatch):
    from checks import mime as queries
    from maillake.operators import attachments, enrich

    texts = []
    for module, name in ((attachments, "save_files"), (enrich, "with_headers"), (queries.export, "to_export")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, real=real: (texts.append(plan(a[0])), real(*a))[1])
    for name in ("saved_attachment_files", "header_full_join_repeated", "export_records"):
        getattr(queries, name)(spark, "/root/testdata/sf0.001")
    assert len(texts) == 3
    assert not any("MapInArrow" in t or "o_orderkey" in t for t in texts)


def test_a_stored_table_leaves_no_shuffle_files(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    stored = lineage.Scratch(spark, "job").write(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert spark.conf.get(setting) == before
    assert sorted(tuple(r) for r in stored.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    last = spark.sparkContext._jsc.sc().newShuffleId() - 1

    def files():
        return [b.name() for b in (all_.apply(i) for all_ in [blocks.getAllBlocks()] for i in range(all_.size())) if b.name().startswith(f"shuffle_{last}_")]

    until = time.monotonic() + 20
    while files() and time.monotonic() < until:
        time.sleep(0.2)
    assert files() == []
