"""Parsing of MIME messages: headers, parts, bodies, attachments, failures."""

from __future__ import annotations

import email
import hashlib
import random
from email.message import EmailMessage
from email.policy import default
from email.utils import getaddresses

import pytest
from pyspark.sql import functions as F

from maillake.operators import attachments, mime, quality, skew
from maillake.operators.message_rows import Headers, header_values, message_values, parsing_policy

RAW = "mailbox string, uid string, content binary"


def raw(spark, contents):
    rows = [("INBOX", str(i), bytearray(c) if c is not None else None) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, RAW)


def compose(*parts, subject="s"):
    """A mixed message of (type, disposition, name, text) parts."""
    message = EmailMessage()
    message["Subject"] = subject
    message.make_mixed()
    for kind, disposition, name, text in parts:
        part = EmailMessage()
        main, sub = kind.split("/")
        if main == "text":
            part.set_content(text, subtype=sub)
        else:
            part.set_content(text.encode(), main, sub, params={"name": name} if name and not disposition else None)
        if "Content-Disposition" in part:
            del part["Content-Disposition"]
        if disposition:
            part.add_header("Content-Disposition", disposition, **({"filename": name} if name else {}))
        message.attach(part)
    return message.as_bytes()


BODIES = {
    "plain and html": ([("text/plain", None, None, "hi\n"), ("text/html", None, None, "<p>x</p>\n")], "hi\n", "", 0),
    "html only": ([("text/html", None, None, "<p>x</p>\n")], "x", "<p>x</p>\n", 0),
    "blank plain": ([("text/plain", None, None, " \n"), ("text/html", None, None, "<p>x</p>\n")], "x", "<p>x</p>\n", 0),
    "inline plain": ([("text/plain", "inline", None, "hi\n")], "", "", 1),
    "name only": ([("application/pdf", None, "a.pdf", "data")], "", "", 1),
    "second plain": ([("text/plain", "attachment", "a.txt", "no\n"), ("text/plain", None, None, "one\n"), ("text/plain", None, None, "two\n")], "one\n", "", 1),
    "other disposition": ([("text/plain", "form-data", "a.txt", "yes\n")], "yes\n", "", 0),
}


@pytest.mark.parametrize("mode", ["nodes", "flat"])
def test_bodies(spark, mode):
    names = list(BODIES)
    parsed = mime.parse_messages(raw(spark, [compose(*BODIES[n][0]) for n in names]), html_mode=mode)
    for row in parsed.collect():
        _, text, html, count = BODIES[names[int(row["uid"])]]
        assert row["error"] is None
        got = (row["body_text"].replace("\r\n", "\n"), row["body_html"].replace("\r\n", "\n"), len(row["attachments"]))
        assert got == (text, html, count), names[int(row["uid"])]


def test_forwarded_text_becomes_body(spark):
    inner = EmailMessage()
    inner["Subject"] = "inner"
    inner.set_content("nested\n")
    outer = EmailMessage()
    outer["Subject"] = "outer"
    outer.add_attachment(inner)
    row = mime.parse_messages(raw(spark, [outer.as_bytes()])).first()
    assert row["body_text"].strip() == "nested" and row["attachments"] == []
    parts = mime.explode_parts(mime.parse_messages(raw(spark, [outer.as_bytes()]))).orderBy("part_index").collect()
    assert [(p["part_index"], p["is_multipart"]) for p in parts] == [(1, True), (2, True), (3, False)]


def test_charsets_and_transfer_encodings(spark):
    contents = [
        b"Content-Type: text/plain; charset=iso-8859-1\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\nf=FCr",
        b"Content-Type: text/plain; charset=x-nowhere\r\n\r\n" + "für".encode(),
        b"Content-Type: text/plain\r\nContent-Transfer-Encoding: base64\r\n\r\nZsO8cg==",
        b"Content-Type: text/plain\r\n\r\nf\xffr",
        b"Subject: none\r\n\r\n",
    ]
    rows = mime.parse_messages(raw(spark, contents)).orderBy("uid").collect()
    assert [r["body_text"] for r in rows] == ["für", "für", "für", "f�r", ""]


def test_attachment_record(spark):
    content = (
        b'Content-Type: image/png; name="a/b.png"\r\nContent-ID: <c1@x>\r\nContent-Transfer-Encoding: base64\r\n'
        b"Content-Disposition: inline\r\n\r\nAAEC"
    )
    parsed = mime.parse_messages(raw(spark, [content]), keep_payload=True)
    record = parsed.first()["attachments"][0]
    data = bytes([0, 1, 2])
    assert record.asDict() == {
        "filename": "a_b.png", "content_type": "image/png", "size": 3, "sha256": hashlib.sha256(data).hexdigest(),
        "saved_path": None, "content_id": "c1@x",
    }
    row = attachments.inventory(parsed).first()
    assert bytes(row["payload"]) == data and row["stored_name"] == "a_b_0_1.png"
    assert mime.parse_messages(raw(spark, [content])).first()["parts"][0]["payload"] is None


def test_headers(spark):
    content = (
        b"From: =?utf-8?q?Doe=2C_J=C3=B6hn?= <J@x.com>\r\nTo: A <a@x.com>,\r\n b@y.com\r\nCc: Team: c@x.com, d@y.com;\r\n"
        b"Bcc: undisclosed-recipients:;\r\nSubject: =?utf-8?q?Re=3A?=\r\n caf=?utf-8?q?=C3=A9?=\r\n"
        b"Date: 15 Jan 2024 10:30:00 +0100 (CET)\r\nMessage-ID:  <M1@X>\r\nIn-Reply-To: see <P@x> and <Q@x>\r\n"
        b"References: <R1@x>\r\n\t<r2@x> junk\r\nFrom: second@x.com\r\n\r\nbody\r\n"
    )
    for parsed in (mime.parse_headers(raw(spark, [content])), mime.parse_messages(raw(spark, [content]))):
        row = parsed.first()
        assert tuple(row["from"]) == ("Doe, Jöhn", "J@x.com")
        assert [tuple(a) for a in row["to"]] == [("A", "a@x.com"), ("", "b@y.com")]
        assert [tuple(a) for a in row["cc"]] == [("", "c@x.com"), ("", "d@y.com")]
        assert [tuple(a) for a in row["bcc"]] == [("", "")]
        assert row["message_id"] == "m1@x" and row["in_reply_to"] == "p@x" and row["references"] == ["r1@x", "r2@x"]
        assert row["date_header"] == "Mon, 15 Jan 2024 10:30:00 +0100" and row["date_utc"] == "2024-01-15T09:30:00Z"


def test_missing_headers(spark):
    row = mime.parse_headers(raw(spark, [b"X-Other: 1\r\n\r\n"])).first()
    assert tuple(row["from"]) == ("", "") and row["to"] == [] and row["references"] == []
    assert (row["subject"], row["subject_canonical"]) == ("", "")
    assert (row["message_id"], row["in_reply_to"], row["date_header"], row["date_utc"]) == (None, None, None, None)


def test_header_block(spark):
    df = raw(spark, [b"A: 1\r\nB: 2\r\n\r\nbody\r\n\r\nmore", b"A: 1\n\nbody", b"A: 1\r\nB: 2", b"A: 1\r\n\r\n", b"\r\n\r\nx", b"A: \xff\n\r\nx"])
    blocks = [bytes(r["b"]) for r in df.orderBy("uid").select(mime.header_block("content").alias("b")).collect()]
    for block, row in zip(blocks, df.orderBy("uid").collect()):
        whole = email.message_from_bytes(bytes(row["content"]), policy=default)
        assert email.message_from_bytes(block, policy=default).items() == whole.items()
    assert b"body" not in blocks[0]


def test_plain_headers_read_the_same_either_way():
    """The shortcut for plain values must agree with the structured parser."""
    rng = random.Random(5)
    bits = ["a", "B1", "x.y", "x@y.com", "<a.b@c-d.org>", '"Q, R"', '"S T"', ",", ", ", " ", "  ", "\t", "\r\n ", "re:", "[1]", "<", ">", "=?", ".", "@", "é", ";", "(c)", "a_b+c@d.e"]
    plain = 0
    for _ in range(4000):
        value = "".join(rng.choice(bits) for _ in range(rng.randint(1, 7)))
        name = rng.choice(["From", "To", "Subject", "Message-ID", "In-Reply-To", "References"])
        content = f"{name}: {value}\r\n\r\n".encode()
        message = email.message_from_bytes(content, policy=default)
        try:
            direct = str(message[name])
            want = getaddresses([direct]) if name in ("From", "To") and direct else direct
        except Exception:
            continue
        headers = Headers(email.message_from_bytes(content, policy=parsing_policy()))
        if name in ("From", "To"):
            got = [(a["name"], a["email"]) for a in headers.addresses(name.lower())]
            want = [(n.strip(), a.strip()) for n, a in want] if want else []
        else:
            got = {"Subject": "subject", "Message-ID": "message_id_header", "In-Reply-To": "in_reply_to_header", "References": "references_header"}[name]
            got = header_values(email.message_from_bytes(content, policy=parsing_policy()))[got]
            if name == "Subject" and "=?" in want:
                continue
        assert got == want, content
        plain += 1
    assert plain > 3000


BROKEN = {
    "scan": None,
    "parse": b"Content-Type: text/plain; charset*=\"'\r\n\r\nx",
    "headers": b"To: a@[\r\n\r\nx",
    "body": b"Content-Disposition: attachment; filename*0*=\"'\r\n\r\nx",
}


def test_quarantine(spark):
    contents = [b"Subject: fine\r\n\r\nhi", *BROKEN.values()]
    parsed = mime.parse_messages(raw(spark, contents))
    good, bad = quality.split_bad_rows(parsed)
    assert [r["subject"] for r in good.collect()] == ["fine"]
    assert sorted(r["stage"] for r in bad.collect()) == sorted(BROKEN)
    assert {r["stage"]: r["messages"] for r in quality.quarantine_counts(parsed).collect()} == {"ok": 1, **dict.fromkeys(BROKEN, 1)}
    assert message_values(None, True, False, True)["stage"] == "scan"


def test_large_batches_are_split(spark, monkeypatch):
    monkeypatch.setattr(mime, "BATCH_BYTES", 5000)
    contents = [b"Subject: n%d\r\n\r\n" % i + b"x" * 1500 for i in range(40)]
    rows = mime.parse_messages(raw(spark, contents).coalesce(1)).orderBy(F.col("uid").cast("int")).collect()
    assert [r["subject"] for r in rows] == [f"n{i}" for i in range(40)]
    assert all(len(r["body_text"]) == 1500 for r in rows)


def test_unknown_html_mode(spark):
    with pytest.raises(ValueError):
        mime.parse_messages(raw(spark, []), html_mode="other")


def test_one_parse_stage(spark, plan):
    text = plan(mime.parse_messages(raw(spark, [b"x"])))
    assert text.count("MapInArrow") == 1 and "ArrowEvalPython" not in text and "Exchange" not in text


def test_rollup_and_store(spark, tmp_path, monkeypatch):
    content = compose(("application/pdf", "attachment", "a.pdf", "same"), ("application/pdf", "attachment", "b.pdf", "same"), ("text/plain", "attachment", "c.txt", "other\n"))
    files = attachments.inventory(mime.parse_messages(raw(spark, [content] * 50), keep_payload=True))
    attachments.write_table(files, str(tmp_path / "table"))
    table = spark.read.parquet(str(tmp_path / "table"))
    whole = attachments.rollup(table).first()
    assert (whole["attachments"], whole["contents"]) == (150, 2)
    uses = {r["size"]: r for r in attachments.dedup(table).collect()}
    assert uses[4]["uses"] == 100 and uses[4]["names"] == 2 and uses[4]["saved_bytes"] == 4 * 99
    assert attachments.content_names(table).count() == 3
    for limit, name in ((skew.BROADCAST_BYTES, "store"), (-1, "joined")):
        monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
        attachments.write_store(table, str(tmp_path / name), owner_bytes=1)
        stored = spark.read.parquet(str(tmp_path / name)).collect()
        assert sorted(bytes(r["payload"]).strip() for r in stored) == [b"other", b"same"]
        assert all(hashlib.sha256(r["payload"]).hexdigest() == r["sha256"] for r in stored)


def test_remembered_headers_are_bounded_by_their_text():
    from maillake.operators import message_rows

    registry = message_rows.RememberedHeaders()
    for i in range(20_000):
        assert str(registry("to", f"name{i} <a{i}@b.example>")) == f"name{i} <a{i}@b.example>"
    assert registry.held <= message_rows.CACHED_TEXT
    assert registry.held == sum(len(n) + len(v) for n, v in registry.parsed)
    before = len(registry.parsed)
    registry("to", "a@b.example, " * 200 + "a@b.example")
    assert len(registry.parsed) == before and registry("subject", "s") is registry("subject", "s")


def test_only_attachments_keep_their_bytes(spark):
    content = compose(("text/plain", None, None, "body\n"), ("application/pdf", "attachment", "a.pdf", "pdf"))
    parts = mime.explode_parts(mime.parse_messages(raw(spark, [content]), keep_payload=True)).collect()
    assert [p["payload"] is not None for p in parts if not p["is_multipart"]] == [False, True]


def test_codecs():
    from maillake.operators.message_rows import charset_text, codec_of

    assert codec_of(None) == codec_of("x-nowhere") == codec_of("base64") == codec_of("a\0b") == "utf-8"
    assert charset_text(b"f\xfcr", "latin-1") == "für" and charset_text(b"\xff", None) == "\ufffd"
