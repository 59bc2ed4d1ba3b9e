"""Token ids in binary shard files with a minimal perfect hash index.

Documents are put in key order over the shards, encoded, and written as raw little-endian ids. A shard file is

    ids of all its documents | keys | levels of the hash | index rows | JSON footer | footer length | magic

The hash maps each distinct key of the shard to a row of its own (0 to n - 1, none left out); the row holds a
fingerprint of the key, the first document's place and the number of documents with that key. A look-up
reads the few bits of each level and one row, whatever the number of keys, and refuses keys whose fingerprint
differs. Ids take 2 bytes where the vocabulary allows, else 4.

Defined results: a null text is empty (only the end id); a null key is a key of its own and comes first;
documents with equal keys follow each other in the order of their texts and are found together; an empty table gives
no shards. Columns besides key and text are not stored.
"""

from __future__ import annotations

import io
import json
import os
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import per_process

END = 0
SHARD_BYTES = 32 * 1024 * 1024  # of text
MAGIC = b"TOKIDX01"
MANIFEST = "shard int, file string, docs long, ids long, first_key long, last_key long"
KNOWN_PIECES = 800_000  # remembered by a worker, besides those of one round
ENCODE_BYTES = 1 << 23
JOINED = 4096  # new pieces that are encoded as one text
GAMMA = 2.0
LEVELS = 24


# -- encoding ---------------------------------------------------------------------------------------


def _white(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether three bytes begin with (or are, for a character of three bytes) white space or a control character."""
    plain = (a <= 0x20) | (a == 0x7F)
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    spaces = (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    three = ((a == 0xE2) & (spaces | ((b == 0x81) & (c == 0x9F)))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80))
    return plain | two | three | ((a == 0xE3) & (b == 0x80) & (c == 0x80))


def visible_blanks(data: np.ndarray) -> np.ndarray:
    """Places of the blanks between two visible characters of UTF-8 bytes."""
    at = np.flatnonzero(data == 0x20)
    padded = np.concatenate([np.full(3, 0x20, np.uint8), data, np.full(3, 0x20, np.uint8)])
    near = [padded[at + 3 + k] for k in range(-3, 4)]
    before = _white(near[0], near[1], near[2]) & (near[0] >= 0xE0) | _white(near[1], near[2], near[2]) & (near[1] == 0xC2)
    return at[~(before | (near[2] <= 0x20) | (near[2] == 0x7F) | _white(near[4], near[5], near[6]))]


def _joinable(piece: bytes) -> bool:
    """Whether a piece begins with a blank before a visible character and ends with a visible one."""
    if piece[:1] != b" " or len(piece) < 2:
        return False
    if 0x20 < piece[1] < 0x7F and 0x20 < piece[-1] < 0x7F:
        return True
    text = piece.decode()
    return min(text[1], text[-1]) > " " and "\x7f" not in (text[1], text[-1]) and not text[1].isspace() and not text[-1].isspace()


class Encoder:
    """Ids of whole texts; pieces seen before are not encoded again.

    With byte-level pre-tokens, a token never spans a single blank between two visible characters, so a text
    is the sum of the pieces that begin at those blanks. Pieces are slices of the Arrow buffer: the distinct ones of some
    megabytes are looked up, and the ids of all are gathered by number. Other tokenizers get their texts whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        made = json.loads(self.tokenizer.to_str())
        before = made.get("pre_tokenizer") or {}
        self.by_piece = (
            before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and not made.get("normalizer")
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in made["added_tokens"])
        )
        # Bytes that each id stands for: byte-level tokens are written with one character per byte.
        names = sorted(self.tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda item: item[1])
        whole = {t["id"] for t in made["added_tokens"]}
        self.widths = np.zeros(names[-1][1] + 1 if names else 1, np.int64)
        for name, number in names:
            self.widths[number] = len(name.encode()) if number in whole else len(name)
        self.marks = dict(zip((b",", b"."), self._encoded([",", "."])))
        self._forget([], np.empty(0, self.dtype), np.empty(0, np.int64))

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype) for e in found]

    def _forget(self, pieces: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Know just these pieces."""
        self.known: dict[bytes, int] = {}
        self.pool, self.used = np.empty(1 << 16, self.dtype), 0  # ids of all known pieces
        self.start, self.length, self.seen = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self._add(pieces, ids, lengths)

    def _add(self, pieces: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Know pieces whose ids lie one after the other."""
        n, m = len(self.known), len(pieces)
        while n + m > len(self.start):
            wider = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.length, self.seen))
            self.start, self.length, self.seen = wider
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + m] = lengths
        self.used += len(ids)
        self.known.update(zip(pieces, range(n, n + m)))

    def _add_each(self, pieces: list[bytes]) -> None:
        """Know pieces that have to be encoded one by one."""
        for i in range(0, len(pieces), 4096):
            found = self._encoded([p.decode() for p in pieces[i : i + 4096]])
            self._add(pieces[i : i + 4096], np.concatenate(found), np.array([len(f) for f in found], np.int64))

    def _ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known pieces one after the other, and how many each has."""
        lengths = self.length[numbers]
        ends = np.cumsum(lengths)
        at = np.repeat(self.start[numbers] - ends + lengths, lengths)
        at += np.arange(len(at))
        return self.pool[at], lengths

    def _add_joined(self, pieces: list[bytes]) -> None:
        """Know joinable pieces: encoded as one text, whose ids are cut where the pieces end."""
        for i in range(0, len(pieces), JOINED):
            part = pieces[i : i + JOINED]
            ids = self.tokenizer.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0].ids
            ids = np.array(ids, np.int64)
            reached = np.cumsum(self.widths[ids])
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
            at = np.minimum(np.searchsorted(reached, ends), len(ids) - 1)
            if (reached[at] != ends).any():
                self._add_each(part)
            else:
                self._add(part, ids.astype(self.dtype), np.diff(at, prepend=-1))

    def _learn(self, wanted: list[bytes]) -> None:
        """Make these new pieces known.

        A comma or full stop behind a letter is a token border, so such a piece is known once its word is. Pieces that are
        cut at visible blanks on both sides are encoded together, others (the ends of texts) alone.
        """
        ended = {mark: [p for p in wanted if p[-1:] == mark and p[-2:-1].isalpha()] for mark in self.marks}
        skipped = {p for own in ended.values() for p in own}
        fresh = dict.fromkeys(p for p in wanted if p not in skipped)
        fresh.update(dict.fromkeys(w for p in skipped if (w := p[:-1]) not in self.known))
        plain = list(filter(_joinable, fresh))
        self._add_joined(plain)
        easy = set(plain)
        self._add_each([p for p in fresh if p not in easy])
        for mark, own in ended.items():
            if own:
                numbers = np.fromiter((self.known[p[:-1]] for p in own), np.int64, len(own))
                ids, lengths = self._ids_of(numbers)
                last, size = self.marks[mark], len(self.marks[mark])
                together = np.insert(ids, np.repeat(np.cumsum(lengths), size), np.tile(last, len(own)))
                self._add(own, together, lengths + size)

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The numbers of distinct pieces, learnt if they are new."""
        if len(self.known) + len(pieces) > KNOWN_PIECES:
            self._forget_rare()
        new = [p for p in pieces if p not in self.known]
        if new:
            self._learn(new)
        numbers = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        self.seen[numbers] += 1
        return numbers

    def _forget_rare(self) -> None:
        """Keep what was there in several slices, at most half of what may be known."""
        seen = self.seen[: len(self.known)]
        least = 2
        while (seen >= least).sum() > KNOWN_PIECES // 2:
            least += 1
        kept = np.flatnonzero(seen >= least)
        pieces = np.array(list(self.known), object)[kept].tolist()
        ids, lengths = self._ids_of(kept)
        self._forget(pieces, ids, lengths)

    def _gathered(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has."""
        coded = pieces.dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_pylist())
        return self._ids_of(numbers[coded.indices.to_numpy(zero_copy_only=False)])

    def texts(self, column: pa.Array) -> list[bytes]:
        """The ids of each text as bytes, without the end id."""
        column = column.fill_null("")
        if not self.by_piece:
            return [ids.tobytes() for ids in self._encoded(column.to_pylist())]
        column = column.cast(pa.large_binary())
        n, buffers = len(column), column.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
        size = int(offsets[-1])
        data = np.frombuffer(buffers[2], np.uint8)[:size] if buffers[2] else np.zeros(0, np.uint8)
        inside = data[offsets[0] :]
        cuts = np.sort(np.concatenate([offsets, visible_blanks(inside) + offsets[0]]), kind="stable")  # merges two runs
        cuts = cuts[np.append(True, cuts[1:] != cuts[:-1])]
        found, counts, low = [], [], 0
        while low < len(cuts) - 1:  # some megabytes, or one piece that is longer
            high = max(low + 1, int(np.searchsorted(cuts, cuts[low] + ENCODE_BYTES, side="right")) - 1)
            slices = [None, pa.py_buffer(np.ascontiguousarray(cuts[low : high + 1])), buffers[2]]
            ids, many = self._gathered(pa.Array.from_buffers(pa.large_binary(), high - low, slices))
            found.append(ids)
            counts.append(many)
            low = high
        ids = np.concatenate([np.empty(0, self.dtype), *found])
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))])
        bounds = ends[np.searchsorted(cuts, offsets)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


# -- minimal perfect hash ---------------------------------------------------------------------------


def key_hash(keys: Sequence[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))


def mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of hashes; other seeds give independent values."""
    with np.errstate(over="ignore"):
        x = values + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A cascade of bit arrays: a level keeps the keys that are alone on their bit, the next gets the rest.

    A key's number is the rank of its bit. Keys left after the last level are listed, so any set of distinct
    hashes works.
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray) -> None:
        self.levels, self.rest = levels, rest
        self.ranks = []
        self.size = 0
        for bits in levels:
            self.ranks.append(self.size + np.concatenate([[0], np.cumsum(bits, dtype=np.int64)]))
            self.size += int(bits.sum())
        self.size += len(rest)

    @staticmethod
    def build(hashes: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        left = hashes
        while len(left) and len(levels) < LEVELS:
            size = max(8, int(GAMMA * len(left)))
            at = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            left = left[~bits[at]]
        return PerfectHash(levels, np.sort(left))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those that certainly are not keys."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for k, bits in enumerate(self.levels):
            at = (mixed(hashes[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.ranks[k][at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, hashes[open_]), len(self.rest) - 1)
            hit = self.rest[at] == hashes[open_]
            out[open_[hit]] = self.size - len(self.rest) + at[hit]
        return out


# -- files ------------------------------------------------------------------------------------------


def key_bytes(key: int | None) -> bytes:
    return b"" if key is None else int(key).to_bytes(8, "little", signed=True)


# Names that Hadoop gives to stores which Arrow knows under another one; fixed values.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file"}


def arrow_uri(folder: str) -> str | None:
    """The folder as a URI that Arrow opens; None for a plain local path."""
    scheme, colon, rest = folder.partition(":")
    if not colon or not rest.startswith("/"):
        return None
    if scheme.lower() not in {*ARROW_SCHEMES, "s3", "gcs"}:
        raise ValueError(f"token files cannot be written to {scheme}: folders")
    return f"{ARROW_SCHEMES.get(scheme.lower(), scheme.lower())}:{rest}"


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, given as a URI or a path."""
    uri = arrow_uri(folder)
    return (fs.LocalFileSystem(), folder) if uri is None else fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; ids go out as they come, only keys and lengths are held."""

    def __init__(self, stream, dtype: np.dtype) -> None:
        self.stream, self.dtype = stream, dtype
        self.end = np.array([END], dtype).tobytes()
        self.keys: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, key: int | None, ids: bytes) -> None:
        self.stream.write(ids + self.end)
        self.keys.append(key)
        self.lengths.append(len(ids) // self.dtype.itemsize + 1)

    def finish(self) -> int:
        """Write keys, index and footer; returns the number of ids."""
        missing = np.array([k is None for k in self.keys], bool)
        keys = np.array([0 if k is None else k for k in self.keys], "<i8")
        offsets = np.concatenate([[0], np.cumsum(np.array(self.lengths, "<i8"))]).astype("<i8")
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (missing[1:] != missing[:-1])
        first = np.flatnonzero(new)
        hashes = key_hash([key_bytes(self.keys[i]) for i in first])
        perfect = PerfectHash.build(hashes)
        rows = np.zeros(len(first), [("fingerprint", "<u4"), ("first", "<u4"), ("count", "<u4")])
        number = perfect.numbers(hashes)
        rows["fingerprint"][number] = mixed(hashes, 1 << 20) >> np.uint64(32)
        rows["first"][number] = first
        rows["count"][number] = np.diff(np.append(first, len(keys)))
        sections = {"keys": keys, "missing": np.packbits(missing), "offsets": offsets}
        sections |= {f"level{k}": np.packbits(bits) for k, bits in enumerate(perfect.levels)}
        sections |= {"rest": perfect.rest.astype("<u8"), "rows": rows}
        at = int(offsets[-1]) * self.dtype.itemsize
        footer: dict = {"dtype": self.dtype.str, "docs": len(keys), "ids": int(offsets[-1])}
        footer["level_bits"] = [len(bits) for bits in perfect.levels]
        for name, values in sections.items():
            data = values.tobytes()
            self.stream.write(data)
            footer[name] = [at, len(data)]
            at += len(data)
        text = json.dumps(footer).encode()
        self.stream.write(text + len(text).to_bytes(8, "little") + MAGIC)
        return int(offsets[-1])


class ShardReader:
    """Keyed access to a shard file."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        tail = self._bytes(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token shard")
        length = int.from_bytes(tail[:8], "little")
        self.footer = json.loads(self._bytes(size - 16 - length, length))
        self.docs, self.dtype = self.footer["docs"], np.dtype(self.footer["dtype"])
        levels = []
        for k, n in enumerate(self.footer["level_bits"]):
            levels.append(np.unpackbits(self._section(f"level{k}", "u1"), count=n).astype(bool))
        self.perfect = PerfectHash(levels, self._section("rest", "<u8"))
        self.rows = self._section("rows", [("fingerprint", "<u4"), ("first", "<u4"), ("count", "<u4")])
        self.offsets = self._section("offsets", "<i8")

    def _bytes(self, at: int, length: int) -> bytes:
        self.source.seek(at)
        return self.source.read(length)

    def _section(self, name: str, dtype) -> np.ndarray:
        return np.frombuffer(self._bytes(*self.footer[name]), dtype)

    def keys(self) -> list[int | None]:
        """All keys in file order."""
        missing = np.unpackbits(self._section("missing", "u1"), count=self.docs)
        return [None if m else int(k) for k, m in zip(self._section("keys", "<i8"), missing)]

    def find(self, keys: Sequence[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first document of each key, and how many there are; 0 for unknown keys."""
        hashes = key_hash([key_bytes(k) for k in keys])
        number = self.perfect.numbers(hashes)
        rows = self.rows[np.maximum(number, 0)] if len(self.rows) else np.zeros(len(keys), self.rows.dtype)
        good = (number >= 0) & (rows["fingerprint"] == (mixed(hashes, 1 << 20) >> np.uint64(32)).astype(np.uint32))
        return np.where(good, rows["first"], 0).astype(np.int64), np.where(good, rows["count"], 0).astype(np.int64)

    def ids(self, place: int) -> np.ndarray:
        """The ids of the document at a place, with its end id."""
        width = self.dtype.itemsize
        start, end = int(self.offsets[place]), int(self.offsets[place + 1])
        return np.frombuffer(self._bytes(start * width, (end - start) * width), self.dtype)

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of every document with that key."""
        first, count = self.find([key])
        return [self.ids(int(first[0]) + i) for i in range(int(count[0]))]


# -- jobs -------------------------------------------------------------------------------------------


def write_shards(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encode the documents into shard files under ``folder``; returns the manifest, one row per shard.

    ``folder`` is shared by driver and executors. Every attempt of a task writes a file of its own and the
    stored manifest names those of the attempts that counted, so lost executors and repeated tasks do no harm.
    Texts are dealt by ranges of (key, hash of the text), so a frequent key is no single range.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = narrow.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    order = ["key", F.xxhash64("text"), "text"]
    dealt = narrow.repartitionByRange(int(shards), *order[:2]).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        writer = stream = None
        files, base = _place(folder)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        encoder = per_process(f"encoder:{tokenizer}", lambda: Encoder(tokenizer))
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                files.create_dir(base, recursive=True)
                stream = files.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)
                writer = ShardWriter(stream, encoder.dtype)
            for k, ids in zip(batch.column(0).to_pylist(), encoder.texts(batch.column(1))):
                writer.add(k, ids)
        if writer is None:
            return
        ids = writer.finish()
        stream.close()
        row = [shard, name, len(writer.keys), ids, writer.keys[0], writer.keys[-1]]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        columns = ["shard", "file", "docs", "ids", "first_key", "last_key"]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=columns)

    dealt.mapInArrow(encode, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The shards in order, with ``start``: ids in all shards before each. One row per shard file."""
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long")
    return spark.read.parquet(f"{folder}/manifest").withColumn("start", start)


DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, place long"


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """Read all shard files back, each document through the index: start, length and CRC-32 of its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(f"{base}/{row['file']}") as source:
                    yield _digests(ShardReader(source), row)

    # With a number: the manifest is tiny, and adaptive execution would read all files in one task.
    tasks = manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
    return tasks.mapInArrow(read, DIGESTS)


def _digests(reader: ShardReader, row: dict) -> pa.RecordBatch:
    keys = reader.keys()
    first, count = reader.find(keys)
    places = np.arange(len(keys))
    if not ((first <= places) & (places < first + count)).all():
        raise ValueError(f"{row['file']}: the index does not lead to its documents")
    crc = [zlib.crc32(reader.ids(int(p)).astype("<u4").tobytes()) for p in places]
    columns = {
        "doc_id": pa.array(keys, pa.int64()),
        "start": pa.array(reader.offsets[:-1] + row["start"], pa.int64()),
        "n_tokens": pa.array(np.diff(reader.offsets), pa.int64()),
        "ids_crc32": pa.array(crc, pa.int64()),
        "shard": pa.array([row["shard"]] * len(keys), pa.int32()),
        "place": pa.array(places, pa.int64()),
    }
    return pa.RecordBatch.from_pydict(columns)


def fetch(manifest: DataFrame, folder: str, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ids of the wanted keys: each key goes to the shards whose key range holds it and is looked up there."""
    ranges = manifest.select("shard", "file", "first_key", "last_key").collect()  # one row per shard file
    bounds = [(r["shard"], r["file"], r["first_key"], r["last_key"]) for r in sorted(ranges)]

    def shards_of(column: Column) -> Column:
        hits = [
            F.when(
                (column.isNull() & F.lit(low is None)) | (column >= F.lit(low if low is not None else -(2**63)))
                & (column <= F.lit(high if high is not None else -(2**63))),
                F.lit(file),
            )
            for _, file, low, high in bounds
        ]
        return F.explode(F.filter(F.array(*hits), lambda f: f.isNotNull()))

    asked = wanted.select(F.col(key).cast("long").alias("key")).distinct()
    routed = asked.withColumn("file", shards_of(F.col("key"))).repartition("file").sortWithinPartitions("file")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _place(folder)
        name, reader = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    name = row["file"]
                    reader = ShardReader(io.BytesIO(b"") if name is None else files.open_input_file(f"{base}/{name}"))
                found = reader.get(row["key"])
                arrays = [pa.array([row["key"]] * len(found), pa.int64()), pa.array([f.tolist() for f in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "ids"])

    return routed.mapInArrow(look, "key long, ids array<long>")
