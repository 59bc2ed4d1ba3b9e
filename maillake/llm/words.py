"""Words and word shingles as 64-bit hashes, straight from the bytes of Arrow string columns.

A word is a run of ASCII letters and digits and of other characters' bytes; ASCII and Latin-1 letters count in lower
case. Everything works on whole arrays: a word's hash is a difference of running sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SHINGLE = 5


def _odd_powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        return np.cumprod(powers)


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        _POWERS["up"] = _odd_powers(_BASE, CHUNK + 1)
        _POWERS["down"] = _odd_powers(pow(_BASE, -1, 1 << 64), CHUNK + 1)
    return _POWERS["up"], _POWERS["down"]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
for _low, _high in ((48, 58), (97, 123), (128, 256)):
    _IS_WORD[_low:_high] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _chunk_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a chunk, and each word's first byte; no word crosses one of ``starts``."""
    up, down = _powers()
    low = _LOWER[data]
    capital = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = capital[(low[capital] >= 0x80) & (low[capital] <= 0x9E) & (low[capital] != 0x97)]
    low[capital] += 0x20
    inside = _IS_WORD[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = starts[starts < len(data)]
    first[at] = inside[at]
    last = np.empty(len(data), bool)  # a word ends after this byte
    last[:-1] = inside[:-1] & (~inside[1:] | first[1:])
    last[-1:] = inside[-1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        hashes = (sums[end] - sums[begin]) * down[begin]
    return mix(hashes), begin


def column_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a column one after the other, and where each text's words begin (n + 1 places)."""
    n = len(column)
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    if n == 0 or buffers[2] is None:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)
    parts: list[np.ndarray] = []
    counts = np.zeros(n, np.int64)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1
        if j > i:
            j = min(j, n)
            chunk = data[offsets[i] : offsets[j]]
            if len(chunk):
                starts = offsets[i:j] - offsets[i]
                hashes, begin = _chunk_words(chunk, starts)
                owner = np.searchsorted(starts, begin, side="right") - 1
                counts[i:j] += np.bincount(owner, minlength=j - i)
                parts.append(hashes)
            i = j
        else:
            for hashes in _long_text(data[offsets[i] : offsets[i + 1]]):
                counts[i] += len(hashes)
                parts.append(hashes)
            i += 1
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return words, np.concatenate([[0], np.cumsum(counts)])


def _long_text(data: np.ndarray) -> Iterator[np.ndarray]:
    """Words of a text longer than a chunk: pieces end between words (a word longer than a chunk is cut)."""
    at = 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        if end < len(data):
            gaps = np.flatnonzero(~_IS_WORD[_LOWER[data[at:end]]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
        yield _chunk_words(data[at:end], np.zeros(1, np.int64))[0]
        at = end


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text; a shorter text is one run of all its words."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(min(size, len(words))):
            out = out * np.uint64(0x100000001B3) + words[k : k + n]
        return mix(out + np.uint64(min(size, len(words))))
