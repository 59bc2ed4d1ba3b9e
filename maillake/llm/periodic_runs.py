"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q (words q apart are identical) and a length of at least
``LEAST`` words and ``POWERS`` periods that no neighbouring word extends.

1. Words of a slice of texts become numbers; a number of its own after each text keeps texts apart.
2. Periods below ``SMALL`` are found by comparing the words with themselves, shifted.
3. For each dyadic scale c, periods from c to below 2c: every window of c + 1 positions selects the position with the
   smallest hash of its next c words. The choice depends on these words only, so two places one period apart in a run
   select alike. Selected positions with equal contexts less than 2c apart propose their distance as a period.
4. Positions inside a run already found whose period is at most c / 3 are left out of the choice: they are the
   highly periodic regions, where every position would look alike. Their periods came from smaller scales.
5. A proposal is extended to both sides word by word; stretches that are long enough are runs. Of several periods of
   one stretch the smallest counts.

Nothing is missed: a run of period q, c <= q < 2c, has at least 3q words, so it holds a window of positions whose contexts
and whose copies one period later lie inside it. Hashes only propose; words decide.

Defined results: a null text has no words; repeated rows are judged alike; an empty table gives an empty one; texts may
be of any length; other columns of the input are kept, and added ones replace columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .store import map_text
from .words import mix

LEAST = 24  # words of a run
POWERS = 3  # periods of a run
SMALL = 8  # the first scale; LEAST covers POWERS of it
SLICE_BYTES = 1 << 21
RUN = "struct<start: long, length: long, period: long>"
ADDED = f"n_words long, runs array<{RUN}>, collapsed string"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NONE = np.uint64(2**64 - 1)


# -- words ------------------------------------------------------------------------------------------


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, and where each text's words begin (n + 1 places)."""
    n = len(texts)
    texts = texts.fill_null("").cast(pa.large_binary())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    at = np.searchsorted(starts, offsets)
    upto = np.concatenate([[0], np.cumsum(inside)])
    ends = np.append(upto[starts], upto[-1]).astype(np.int64)
    kept = pa.py_buffer(np.ascontiguousarray(data[inside]))
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), kept]), at


def joined(words: pa.Array, at: np.ndarray) -> pa.Array:
    """The words of each text with one blank between them."""
    lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), words)
    return pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())


# -- runs -------------------------------------------------------------------------------------------


def small_periods(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs with a period below ``SMALL`` as (start, end, period)."""
    found = []
    for period in range(1, SMALL):
        same = np.flatnonzero(ids[period:] == ids[:-period])
        if len(same) < LEAST - period:
            continue
        breaks = np.flatnonzero(np.diff(same) != 1) + 1
        low = np.concatenate([[0], breaks])
        high = np.append(breaks, len(same))
        for a, b in zip(low, high):
            if b - a + period >= LEAST:
                found.append((int(same[a]), int(same[b - 1]) + 1 + period, period))
    return found


def selected(hashes: np.ndarray, skipped: np.ndarray | None, scale: int) -> np.ndarray:
    """The synchronising set: the position of the first smallest hash of every ``scale + 1`` positions."""
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    keys = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    if skipped is not None:
        keys[skipped] = _NONE
    width = 1
    while 2 * width <= scale + 1:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    rest = scale + 1 - width
    if rest:
        keys = np.minimum(keys[:-rest], keys[rest:])
    keys = keys[keys != _NONE]
    chosen = np.zeros(len(hashes), bool)
    chosen[(keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = True
    return np.flatnonzero(chosen)


def proposals(hashes: np.ndarray, places: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of equal contexts, from ``scale`` to below twice that apart, by distance and place."""
    order = np.argsort(hashes[places], kind="stable")
    at = places[order]
    own = hashes[at]
    firsts, steps = [], []
    for k in range(1, len(at)):
        apart = at[k:] - at[:-k]
        near = (own[k:] == own[:-k]) & (apart < 2 * scale)
        if not near.any():
            break
        near &= apart >= scale
        firsts.append(at[:-k][near])
        steps.append(apart[near])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, step = np.concatenate(firsts), np.concatenate(steps)
    order = np.lexsort((first, step))
    return first[order], step[order]


def _ahead(ids: np.ndarray, at: int, period: int) -> int:
    """The first place from ``at`` on whose word differs from the one a period later."""
    size, last = 64, len(ids) - period
    while at < last:
        stop = min(at + size, last)
        differ = ids[at:stop] != ids[at + period : stop + period]
        if differ.any():
            return at + int(differ.argmax())
        at, size = stop, 2 * size
    return last


def _behind(ids: np.ndarray, at: int, period: int) -> int:
    """The place after the last one before ``at`` whose word differs from the one a period later."""
    size = 64
    while at > 0:
        low = max(0, at - size)
        differ = ids[low:at] != ids[low + period : at + period]
        if differ.any():
            return low + int(np.flatnonzero(differ)[-1]) + 1
        at, size = low, 2 * size
    return 0


def extended(ids: np.ndarray, first: np.ndarray, step: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs (start, end, period) among proposals that come sorted by period and place."""
    found = []
    before, reached = 0, -1  # the last stretch: its period, and the first place behind it
    for at, period in zip(first.tolist(), step.tolist()):
        if period == before and at < reached:
            continue
        before, reached = period, _ahead(ids, at, period)
        if reached == at:
            continue
        start, end = _behind(ids, at, period), reached + period
        if end - start >= max(LEAST, POWERS * period):
            found.append((start, end, period))
    return found


def runs_of(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """All runs as rows (start, length, period), by start and period, over texts that occupy ``bounds[i]:bounds[i + 1]``.

    The last place of each text holds a number that occurs nowhere else.
    """
    best: dict[tuple[int, int], int] = {}
    for start, end, period in small_periods(ids):
        best.setdefault((start, end), period)
    lengths = np.diff(bounds) - 1
    places = np.arange(len(ids))
    with np.errstate(over="ignore"):
        hashes = mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    scale = 1
    while lengths.size and lengths.max() >= POWERS * max(scale, SMALL):
        if scale >= SMALL:
            large = lengths >= POWERS * scale
            if not large.all():  # the rest is too short for these periods
                keep = np.repeat(large, lengths + 1)
                ids, hashes, places, lengths = ids[keep], hashes[keep], places[keep], lengths[large]
            skipped = _highly_periodic(best, places, scale)
            first, step = proposals(hashes, selected(hashes, skipped, scale), scale)
            for start, end, period in extended(ids, first, step):
                span = (int(places[start]), int(places[end - 1]) + 1)
                best[span] = min(best.get(span, period), period)
        after = np.full(len(hashes), np.uint64(scale))
        after[:-scale] = hashes[scale:]
        with np.errstate(over="ignore"):
            hashes = mix(hashes * np.uint64(0x100000001B3) + after)
        scale *= 2
    rows = sorted((start, period, end - start) for (start, end), period in best.items())
    return np.array(rows, np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def _highly_periodic(best: dict[tuple[int, int], int], places: np.ndarray, scale: int) -> np.ndarray | None:
    """Positions whose next ``scale`` words lie in a run found before with a period of at most a third of that."""
    if scale < LEAST:  # shorter stretches are no runs, so they are not known
        return None
    spans = [(start, end) for (start, end), period in best.items() if 3 * period <= scale <= end - start]
    if not spans:
        return None
    edges = np.zeros(len(places) + 1, np.int64)
    low = np.searchsorted(places, [s for s, _ in spans])
    high = np.searchsorted(places, [e - scale for _, e in spans], side="right")
    np.add.at(edges, low, 1)
    np.add.at(edges, np.maximum(low, high), -1)
    return np.cumsum(edges[:-1]) > 0


# -- texts ------------------------------------------------------------------------------------------


def _slices(texts: pa.Array) -> list[pa.Array]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    cuts, low = [0], 0
    while low < len(texts):
        before = sizes[low - 1] if low else 0
        low = max(low + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
        cuts.append(min(low, len(texts)))
    return [texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _judge(texts: pa.Array) -> list[pa.Array]:
    """Number of words, runs and collapsed text of each text."""
    words, at = cut_words(texts)
    n = len(texts)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(at))
    ids = np.full(len(codes) + n, -1, np.int64)
    ids[np.arange(len(codes)) + owner] = codes
    bounds = at + np.arange(n + 1)
    ids[bounds[1:] - 1] = len(codes) + np.arange(n)
    rows = runs_of(ids, bounds)
    text = np.searchsorted(bounds, rows[:, 0], side="right") - 1
    edges = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edges, rows[:, 0] + rows[:, 2] - text, 1)
    np.add.at(edges, rows[:, 0] + rows[:, 1] - text, -1)
    kept = np.cumsum(edges[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(kept)])[at]
    columns = [pa.array(c, pa.int64()) for c in (rows[:, 0] - bounds[text], rows[:, 1], rows[:, 2])]
    listed = pa.StructArray.from_arrays(columns, ["start", "length", "period"])
    counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(counts), listed)
    whole = words if kept.all() else words.filter(pa.array(kept))
    return [pa.array(np.diff(at), pa.int64()), runs, joined(whole, left)]


def judge(texts: pa.Array) -> list[pa.Array]:
    parts = [_judge(part) for part in _slices(texts)]
    if not parts:
        return _judge(texts)
    return [pa.concat_arrays(column) for column in zip(*parts)]


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_words``, ``runs`` (by start and period) and ``collapsed``.

    ``collapsed`` is the text without what repeats: a word goes if any run holds it behind that run's first period; the
    words left are joined by one blank.
    """
    return map_text(docs, judge, ADDED, text)
