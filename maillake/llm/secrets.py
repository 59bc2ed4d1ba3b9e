"""Secret scans through nested encodings.

A text is scanned by three patterns. Then its encoded parts are unwrapped: URL escapes, Unicode escapes, base64, and
compressed bytes inside base64. Each unwrapped layer goes on a worklist, is scanned itself and searched for
further parts, until none is left. Base64 is read line by line and joined over single line ends. Bytes that are not UTF-8 are
replaced, and a broken compressed stream gives what comes before the error. Layers seen before are not unwrapped again, so encodings that lead back to
an earlier layer end. Every character of a layer knows the span of the original text it came from, so all
findings are spans of the original text.

A compressed part has one span, that of the part. It is read as a stream, in windows that overlap and end at white space, so
its size needs no limit and little memory; what is found in it, or in parts inside it, has the part's span.

Defined results: a null text is empty; repeated rows are scanned alike; findings of the same kind and span count
once; an empty table gives an empty one; columns of the input are kept, and the added ones replace columns of
the same name. ``unscanned`` counts places inside compressed parts where a run without white space is longer than
``LONGEST``: it is scanned, but what is encoded in it is unwrapped in pieces.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import map_text

# Kinds in the order in which findings are listed; fixed values.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

WINDOW = 1 << 20  # characters of a compressed part that are scanned at once
OVERLAP = 1 << 12
LONGEST = 1 << 24
STEP = 256  # bytes that are unpacked at once
LEAST_BASE64 = 16
_RUN = re.compile(r"\S+")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_UNICODE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_BASE64)
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+(?:\r?\n[ \t]*[A-Za-z0-9+/_-]++)++={0,2}" % LEAST_BASE64)
_LINE = re.compile(r"[A-Za-z0-9+/_-]+=*")
_ESCAPED = re.compile("[\udc80-\udcff]")
# What tells a run of base64 letters from a word: a digit, a sign, padding or a capital after the first letter.
_CODED = re.compile(r"[0-9+/_=-]|.[A-Z]")
COLUMNS = "base_spans array<string>, layer_spans array<string>, layers int, unscanned int"


class Found(NamedTuple):
    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


class Decoded(NamedTuple):
    """An unwrapped part of a text; its character i came from ``low[i]`` to ``high[i]`` of the part."""

    text: str
    low: np.ndarray
    high: np.ndarray


class Layer(NamedTuple):
    """An unwrapped text. Character i came from ``low[i]`` to ``high[i]`` of the original text, or, if these are numbers,
    all of it came from one span."""

    text: str
    low: np.ndarray | int
    high: np.ndarray | int

    def span(self, start: int, end: int) -> tuple[int, int]:
        if isinstance(self.low, int):
            return self.low, self.high
        return int(self.low[start:end].min()), int(self.high[start:end].max())


class Packed(NamedTuple):
    """Compressed bytes and the span of the part they came from."""

    data: bytes
    low: int
    high: int


def scan(text: str) -> list[Found]:
    """Findings in one text as it stands, by start and kind."""
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST_ASSIGN:
            found.append(Found(m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST_ACCESS:
                found.append(Found(m.start(), 1, m.end()))
    found.extend(Found(m.start(), 2, m.end()) for m in HEX.finditer(text))
    return sorted(found)


def _decoded_bytes(data: bytes, low: np.ndarray, high: np.ndarray) -> Decoded:
    """Bytes as text with the place of each character; a byte that is not UTF-8 becomes a replacement character."""
    text = data.decode("utf-8", "surrogateescape")
    if len(text) != len(data):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        escaped = (codes >= 0xDC80) & (codes <= 0xDCFF)
        sizes = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        sizes[escaped] = 1
        ends = np.cumsum(sizes)
        low, high = low[ends - sizes], high[ends - 1]
    return Decoded(_ESCAPED.sub("\ufffd", text), low, high)


def _wide(data: bytes, low: np.ndarray, high: np.ndarray) -> Decoded | None:
    """UTF-16 bytes as text; None if they do not look like it."""
    order = {b"\xff\xfe": "little", b"\xfe\xff": "big"}.get(data[:2])
    if order is None:
        zeros = [data[i::2].count(0) for i in (0, 1)]
        if max(zeros) * 4 < len(data):  # half of all characters
            return None
        order = "big" if zeros[0] > zeros[1] else "little"
    n = len(data) // 2
    units = np.frombuffer(data[: 2 * n], "<u2" if order == "little" else ">u2")
    # One character a unit: halves of a pair are never part of a finding.
    plain = np.where((units >= 0xD800) & (units < 0xE000), 0xFFFD, units).astype("<u2")
    return Decoded(plain.tobytes().decode("utf-16-le"), low[: 2 * n : 2], high[1 : 2 * n : 2])


def _percent(run: str) -> Decoded:
    data, lows, highs, at = bytearray(), [], [], 0

    def plain(upto: int) -> None:
        part = run[at:upto]
        coded = part.encode("utf-8", "surrogatepass")
        own = np.arange(at, upto)
        if len(coded) != len(part):
            own = np.repeat(own, [len(c.encode("utf-8", "surrogatepass")) for c in part])
        data.extend(coded)
        lows.append(own)
        highs.append(own + 1)

    for m in _PERCENT.finditer(run):
        plain(m.start())
        data.append(int(run[m.start() + 1 : m.end()], 16))
        lows.append(np.array([m.start()]))
        highs.append(np.array([m.end()]))
        at = m.end()
    plain(len(run))
    return _decoded_bytes(bytes(data), np.concatenate(lows), np.concatenate(highs))


def _unicode(run: str) -> Decoded:
    out, lows, highs, at = [], [], [], 0
    for m in _UNICODE.finditer(run):
        out.append(run[at : m.start()])
        lows.append(np.append(np.arange(at, m.start()), m.start()))
        highs.append(np.append(np.arange(at, m.start()) + 1, m.end()))
        value = int(m.group().lstrip("\\uUx").strip("{}") or "0", 16)
        out.append(chr(value) if value < 0x110000 and not 0xD800 <= value < 0xE000 else "\ufffd")
        at = m.end()
    out.append(run[at:])
    lows.append(np.arange(at, len(run)))
    highs.append(np.arange(at, len(run)) + 1)
    return Decoded("".join(out), np.concatenate(lows), np.concatenate(highs))


def _kind_of(data: bytes) -> str | None:
    """The compression of bytes, by their first ones."""
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0:
        return "zlib"
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd"
    if data[:3] == b"BZh":
        return "bz2"
    return "xz" if data[:6] == b"\xfd7zXZ\x00" else None


def _engine(kind: str):
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    if kind == "bz2":
        import bz2

        return bz2.BZ2Decompressor()
    if kind == "xz":
        import lzma

        return lzma.LZMADecompressor()
    return zlib.decompressobj(47)


def unpacked(data: bytes) -> Iterator[bytes]:
    """The contents of compressed bytes, some at a time, up to the end or to the first error."""
    kind, at = _kind_of(data), 0
    while kind and at < len(data):
        engine, rest = _engine(kind), b""
        try:
            while not engine.eof:
                if not rest:
                    if at >= len(data):
                        return
                    rest, at = data[at : at + STEP], at + STEP
                if kind in ("gzip", "zlib"):
                    before = engine.copy()
                    try:
                        yield engine.decompress(rest, WINDOW)
                    except zlib.error:  # what comes out before the error
                        yield from _bytewise(before, rest)
                        return
                    rest = engine.unconsumed_tail
                elif kind == "zstd":
                    yield engine.decompress(rest)
                    rest = b""
                else:
                    yield engine.decompress(rest, WINDOW)
                    rest = b""
                    while not engine.needs_input and not engine.eof:
                        yield engine.decompress(b"", WINDOW)
        except Exception:  # broken or foreign bytes
            return
        left = engine.unused_data + data[at:]  # the next member of a file
        data, at = left, 0
        kind = _kind_of(data) if kind != "zlib" else None


def _bytewise(engine, data: bytes) -> Iterator[bytes]:
    try:
        for i in range(len(data)):
            yield engine.decompress(data[i : i + 1])
    except zlib.error:
        return


_SPACE = re.compile(r"\s")


def windows(chunks: Iterator[bytes]) -> Iterator[tuple[str, bool]]:
    """Unpacked bytes as overlapping texts that begin and end at white space, and whether there was none for too long."""
    decoder, held, size, before, enough = codecs.getincrementaldecoder("utf-8")("replace"), [], 0, "", WINDOW
    for chunk in chunks:
        text = decoder.decode(chunk)
        held.append(text)
        size += len(text)
        if size < enough:
            continue
        whole, low = before + "".join(held), len(before)
        spaces = [m.end() for m in _SPACE.finditer(whole, max(low, len(whole) - OVERLAP))] or [m.end() for m in _SPACE.finditer(whole, low)]
        long = not spaces and size >= LONGEST
        if not spaces and not long:
            held, enough = [whole[low:]], min(2 * enough, LONGEST)
            continue
        cut = spaces[-1] if spaces else len(whole) // 4 * 4
        yield whole[:cut], long
        start = max(0, cut - OVERLAP)
        space = _SPACE.search(whole, start, cut)
        before, held, size, enough = whole[space.end() if space else start : cut], [whole[cut:]], len(whole) - cut, WINDOW
    yield before + "".join(held) + decoder.decode(b"", True), False


def _readable(text: str) -> bool:
    """Whether decoded bytes look like text: no control characters but white space."""
    return bool(text) and not re.search(r"[\x00-\x08\x0e-\x1f\x7f\ufffd]", text)


def _coded(text: str) -> bool:
    """Whether there is an encoded part in a text."""
    return bool(_PERCENT.search(text) or _UNICODE.search(text) or any(_CODED.search(m.group()) for m in _BASE64.finditer(text)))


def _base64(run: str) -> Decoded | bytes | None:
    """What a run of base64 letters holds: text, compressed bytes or nothing."""
    body = run.rstrip("=")
    usable = len(body) - (len(body) % 4 == 1)
    coded = body[:usable].replace("-", "+").replace("_", "/")
    try:
        data = base64.b64decode(coded + "=" * (-len(coded) % 4))
    except (binascii.Error, ValueError):
        return None
    if _kind_of(data) is not None and any(unpacked(data)):
        return data
    low = np.arange(len(data)) // 3 * 4
    high = np.minimum(low + 4, len(run))
    found = _wide(data, low, high) or _decoded_bytes(data, low, high)
    # Bytes that are no plain text are a layer only if there is something in them.
    if not _readable(found.text) and not scan(found.text) and not _coded(found.text):
        return None
    return found


def _unwrap(text: str) -> Iterator[tuple[int, int, Decoded | bytes]]:
    """Encoded parts of a text: where the part starts and ends, and what it holds."""
    if "%" in text or "\\" in text:
        for m in _RUN.finditer(text):
            run = m.group()
            if "%" in run and _PERCENT.search(run):
                yield m.start(), m.end(), _percent(run)
            if "\\" in run and _UNICODE.search(run):
                yield m.start(), m.end(), _unicode(run)
    for m in _BASE64.finditer(text):
        run = m.group()
        if _CODED.search(run):
            held = _base64(run)
            if held is not None:
                yield m.start(), m.end(), held
    for m in _WRAPPED.finditer(text):
        for lines in _joined([(p.start(), p.end()) for p in _LINE.finditer(text, m.start(), m.end())]):
            run = "".join(text[a:b] for a, b in lines)
            held = _base64(run) if _CODED.search(run) else None
            if held is None:
                continue
            start, end = lines[0][0], lines[-1][1]
            if isinstance(held, Decoded):
                at = np.concatenate([np.arange(a, b) for a, b in lines]) - start
                held = Decoded(held.text, at[held.low], at[held.high - 1] + 1)
            yield start, end, held


def _joined(lines: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The lines that may be one wrapped text: all, and each run of equally long lines with a shorter one after it."""
    runs, start = [lines], 0
    size = [b - a for a, b in lines]
    for i in range(1, len(lines) + 1):
        if i == len(lines) or size[i] != size[start]:
            end = i + (i < len(lines) and size[i] < size[start])
            if end - start > 1 and end - start < len(lines):
                runs.append(lines[start:end])
            start = i
    return runs


def scan_layers(text: str) -> tuple[list[Found], list[Found], int, int]:
    """Findings of the text itself, further ones of its layers, number of layers, number of places read in pieces."""
    base = scan(text)
    known, more = set(base), set()
    seen: set[tuple[bytes, int]] = set()
    work: list[Layer | Packed] = []
    layers = unscanned = 0

    def is_new(data: bytes, low: int) -> bool:
        mark = (hashlib.blake2b(data, digest_size=16).digest(), low)
        if mark in seen:
            return False
        seen.add(mark)
        return True

    def add(parent: Layer, start: int, end: int, held: Decoded | bytes) -> None:
        nonlocal layers
        low, high = parent.span(start, end)
        if isinstance(held, bytes):
            if is_new(held, low):
                layers += 1
                work.append(Packed(held, low, high))
        elif held.text:
            if isinstance(parent.low, int):
                layer = Layer(held.text, low, high)
            else:
                layer = Layer(held.text, parent.low[held.low + start], parent.high[held.high + start - 1])
                low = int(layer.low[0])
            if is_new(held.text.encode("utf-8", "surrogatepass"), low):
                layers += 1
                work.append(layer)

    def look(layer: Layer) -> None:
        for f in scan(layer.text):
            low, high = layer.span(f.start, f.end)
            if Found(low, f.kind, high) not in known:
                more.add(Found(low, f.kind, high))
        for part in _unwrap(layer.text):
            add(layer, *part)

    for start, end, held in _unwrap(text):  # places of the text itself are known without arrays
        if isinstance(held, bytes):
            add(Layer("", start, end), start, end, held)
        elif held.text and is_new(held.text.encode("utf-8", "surrogatepass"), int(held.low[0]) + start):
            layers += 1
            work.append(Layer(held.text, held.low + start, held.high + start))
    while work:
        layer = work.pop()
        if isinstance(layer, Layer):
            look(layer)
            continue
        for window, long in windows(unpacked(layer.data)):
            unscanned += long
            # Equal windows, as in a bomb, hold the same.
            if window and is_new(window.encode("utf-8", "surrogatepass") + b"\0window", layer.low):
                look(Layer(window, layer.low, layer.high))
    return base, sorted(more), layers, unscanned


TYPES = (pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.int32())


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their findings: ``base_spans`` and ``layer_spans`` as ``kind:start:end`` in order."""

    def run(texts: pa.Array) -> list[pa.Array]:
        rows = []
        for value in texts:
            base, more, layers, unscanned = scan_layers(value.as_py() or "")
            rows.append(([str(f) for f in base], [str(f) for f in more], layers, unscanned))
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(TYPES)]

    return map_text(docs, run, COLUMNS, text, keep=True)


def in_order(spans: str) -> str:
    """SQL that sorts ``kind:start:end`` texts by start, then kind as listed, then end."""
    keyed = (
        f"transform({spans}, s -> struct(cast(split_part(s, ':', 2) as bigint) as start, "
        f"array_position(array({', '.join(repr(k) for k in KINDS)}), split_part(s, ':', 1)) as kind, "
        "cast(split_part(s, ':', 3) as bigint) as end, s as span))"
    )
    return f"array_sort({keyed}).span"
