"""Mail archives (mbox files) as a table, one archive read by many tasks.

A partition is a byte range of a file. It owns the messages whose separator line begins inside it: a task looks for the
first separator from the start of its range on, and reads the last message to its end, beyond the range if need be. So
every message is read once, wherever the borders fall.

A separator is a line that begins with ``From `` at the start of the file or behind an empty line. The message is what
follows up to the next separator, without the newline that ends it; one ``>`` of lines that begin with ``>From `` (or
more of them) is taken off, as writers add it.

``uid`` is the place of the separator in the file, so it identifies the message and keeps the order. Files are opened
through Arrow, by path or URI (``file:``, ``s3a:``, ``hdfs:``).
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTITION_BYTES = 128 * 1024 * 1024
BATCH_BYTES = 8 * 1024 * 1024
CHUNK = 1 << 20
SUFFIX = ".mbox"
SCHEMA = "mailbox string, uid string, uid_n long, content binary"
_BORDER = re.compile(rb"(?:(?<=\n\n)|(?<=\n\r\n))From [^\n]*(?:\n|\Z)")
_FIRST = re.compile(rb"From [^\n]*(?:\n|\Z)")
_QUOTED = re.compile(rb"^>(>*From )", re.M)
_FROM = re.compile(rb"^(>*From )", re.M)
_BEFORE = 3  # bytes before a separator that tell that it is one


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path; a scheme of Hadoop's S3 is Arrow's ``s3``."""
    scheme, colon, rest = path.partition(":")
    if not colon or not rest.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def messages_in(source, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Place and content of the messages whose separators begin in ``[start, end)`` of an open file."""
    at = max(0, start - _BEFORE)
    source.seek(at)
    held, begun, parts, upto = b"", None, [], 0  # bytes from ``at`` on; the open message, its bytes, and up to where they go

    def content(stop: int) -> bytes:
        return _content(b"".join(parts) + held[max(0, upto - at) : stop])

    while True:
        chunk = source.read(CHUNK)
        held += chunk
        last = at + len(held) >= size
        # A separator line may go on in the next chunk, so the last line waits unless the file ends.
        safe = len(held) if last else held.rfind(b"\n") + 1
        found = [m for m in _BORDER.finditer(held, 0, safe) if at + m.start() >= start]
        if at == 0 and start == 0 and begun is None and (first := _FIRST.match(held, 0, safe)):
            found.insert(0, first)
        for m in found:
            if begun is not None:
                yield begun, content(m.start())
                begun = None
            if at + m.start() >= end:
                return
            begun, parts, upto = at + m.start(), [], at + m.end()
        if last:
            if begun is not None:
                yield begun, content(len(held))
            return
        if begun is None and at + safe > end + _BEFORE:
            return
        # What surely belongs to the open message is put aside; the rest is looked at again.
        keep = max(0, safe - _BEFORE)
        if begun is not None and at + keep > upto:
            parts.append(held[max(0, upto - at) : keep])
            upto = at + keep
        held, at = held[keep:], at + keep


def _content(data: bytes) -> bytes:
    """A message without the newline before the next separator, and without added marks."""
    for end in (b"\r\n", b"\n"):
        if data.endswith(end):
            data = data[: -len(end)]
            break
    return _QUOTED.sub(rb"\1", data) if b">From " in data else data


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int


class MboxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options.get("path", "")
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        if not self.path or self.bytes < 1:
            raise ValueError("an archive needs a path, and partitions at least one byte")

    def partitions(self) -> Sequence[InputPartition]:
        files, base = place(self.path)
        info = files.get_file_info(base)
        if info.type == fs.FileType.Directory:
            found = [f for f in files.get_file_info(fs.FileSelector(base)) if f.path.endswith(SUFFIX)]
        else:
            found = [info]
        ranges = [
            Range(f.path, start, min(start + self.bytes, f.size), f.size)
            for f in sorted(found, key=lambda f: f.path)
            for start in range(0, f.size or 0, self.bytes)
        ]
        return ranges or [Range("", 0, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, Range)
        if not partition.size:
            return
        files, _ = place(self.path)
        mailbox = os.path.basename(partition.path).removesuffix(SUFFIX)
        uids: list[int] = []
        contents: list[bytes] = []
        held = 0
        with files.open_input_file(partition.path) as source:
            for at, content in messages_in(source, partition.start, partition.end, partition.size):
                uids.append(at)
                contents.append(content)
                held += len(content)
                if held >= BATCH_BYTES:
                    yield _batch(mailbox, uids, contents)
                    uids, contents, held = [], [], 0
        if uids:
            yield _batch(mailbox, uids, contents)


def _batch(mailbox: str, uids: list[int], contents: list[bytes]) -> pa.RecordBatch:
    arrays = [pa.array([mailbox] * len(uids)), pa.array([str(u) for u in uids]), pa.array(uids, pa.int64()), pa.array(contents, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["mailbox", "uid", "uid_n", "content"])


class MboxSource(DataSource):
    """``spark.read.format("mbox").load(path)``: an archive, or a folder of archives named ``<mailbox>.mbox``."""

    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MboxReader(self.options)


def read_mbox(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """RAW table of archives, in ranges of about ``partition_bytes``."""
    spark.dataSource.register(MboxSource)
    return spark.read.format("mbox").option("partitionBytes", str(partition_bytes)).load(path)


def write_archives(raw: DataFrame, folder: str) -> DataFrame:
    """Write one archive per mailbox under ``folder``, in uid order; returns ``mailbox`` and its number of ``messages``.

    An archive is one file, so one task writes it; this is for archives of usual size, not for the corpus. The file is
    complete before it has its name. ``folder`` is shared by all executors. A message that does not end with a newline gets one.
    """
    order = ["mailbox", "uid_n", "uid"]
    dealt = raw.select(*order, "content").where("content is not null")
    dealt = dealt.repartition(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mailbox").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = place(folder)
        files.create_dir(base, recursive=True)
        name, stream, part, counts = None, None, "", {}
        for batch in batches:
            for mailbox, content in zip(batch.column(0).to_pylist(), batch.column(3)):
                if stream is None or mailbox != name:
                    if stream is not None:
                        stream.close()
                        files.move(part, f"{base}/{name}{SUFFIX}")
                    name, part = mailbox, f"{base}/.{uuid.uuid4().hex}"
                    stream = files.open_output_stream(part)
                counts[mailbox] = counts.get(mailbox, 0) + 1
                data = _FROM.sub(rb">\1", content.as_py())
                stream.write(b"From - \n" + data + (b"\n" if data.endswith(b"\n") else b"\n\n"))
        if stream is not None:
            stream.close()
            files.move(part, f"{base}/{name}{SUFFIX}")
        names, numbers = list(counts), list(counts.values())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64())], names=["mailbox", "messages"])

    return dealt.mapInArrow(run, "mailbox string, messages long")
