"""Archives read in byte ranges: every message once, wherever the borders fall."""

from __future__ import annotations

import io
import mailbox as standard
import random

import pytest

from maillake.sources import mbox


def archive(contents, end=b"\n"):
    out = b""
    for content in contents:
        out += b"From someone Mon Jan  1" + end + mbox._FROM.sub(rb">\1", content) + end
    return out


def messages(rng, n):
    lines = [b"Subject: x", b"", b"From me to you", b">From there", b"text " * 9, b"From", b" From x", b"a" * 300, b"\xff\xfe"]
    return [b"".join(rng.choice(lines) + b"\n" for _ in range(rng.randint(0, 7))) for _ in range(n)]


@pytest.mark.parametrize("end", [b"\n", b"\r\n"])
@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_ranges_of_any_size_read_each_message_once(monkeypatch, end, chunk):
    monkeypatch.setattr(mbox, "CHUNK", chunk)
    rng = random.Random(chunk)
    contents = [m.replace(b"\n", end) for m in messages(rng, 25)]
    data = archive(contents, end)
    for size in (1, 5, 33, 400, len(data)):
        found = []
        for start in range(0, len(data), size):
            found += mbox.messages_in(io.BytesIO(data), start, min(len(data), start + size), len(data))
        assert [c for _, c in found] == contents
        assert [data[p : p + 5] for p, _ in found] == [b"From "] * len(contents)


def test_odd_files():
    read = lambda d: [c for _, c in mbox.messages_in(io.BytesIO(d), 0, len(d), len(d))]
    assert read(b"no archive\n\ntext") == []
    assert read(b"From x\n") == [b""] and read(b"From x") == [b""]
    assert read(b"From x\nbody without end") == [b"body without end"]
    assert read(b"junk\n\nFrom x\na\nFrom inside\n\n") == [b"a\nFrom inside\n"]


def test_scan_equals_the_landed_table(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"box {i % 3}", str(i), i, c) for i, c in enumerate(messages(rng, 90))] + [("box 1", "9999", 9999, None)]
    raw = spark.createDataFrame(rows, "mailbox string, uid string, uid_n long, content binary").repartition(5)
    folder = str(tmp_path / "archives")
    counts = {r["mailbox"]: r["messages"] for r in mbox.write_archives(raw, folder).collect()}
    assert counts == {f"box {k}": 30 for k in range(3)}
    for size in (200, 1 << 20):
        scanned = mbox.read_mbox(spark, folder, size)
        assert (scanned.rdd.getNumPartitions() > 10) == (size == 200)
        got = sorted((r["mailbox"], r["uid_n"], bytes(r["content"])) for r in scanned.collect())
        for box in counts:
            own = [c for b, _, c in got if b == box]
            assert own == [c if c.endswith(b"\n") else c + b"\n" for b, _, _, c in rows if b == box and c is not None]
    # The standard library reads the same archives.
    box = standard.mbox(f"{folder}/box 1.mbox")
    assert len(box) == 30
    one = mbox.read_mbox(spark, f"{folder}/box 2.mbox")
    assert one.count() == 30 and {r["mailbox"] for r in one.select("mailbox").distinct().collect()} == {"box 2"}


def test_an_empty_folder_and_wrong_options(spark, tmp_path):
    assert mbox.read_mbox(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="path"):
        mbox.read_mbox(spark, "").count()
