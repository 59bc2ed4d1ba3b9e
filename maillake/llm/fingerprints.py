"""Document fingerprints by a threshold-scaled sketch.

The fingerprint of a text is the set of all hashes of its shingles (runs of five words; all words of a shorter text) below
a fixed fraction of the hash range, so a text twice as long has a fingerprint twice as large. A small text may have no such
hash, so the smallest hash always stays.

* Union: the fingerprint of several texts' shingles is ``merged`` from theirs, without the texts.
* Containment: both fingerprints hold the same sample of the hash range, so the share of one that is in the other
  estimates the share of its shingles there, however unequal the texts are. ``likeness`` is the larger of both directions,
  ``resemblance`` the Jaccard estimate.

Defined results: a null text is empty; a text without words has an empty fingerprint, which is like an empty one (1) and
unlike all others (0); equal texts have equal fingerprints; repeated rows have each their own result; an empty table gives an
empty one; texts may be of any length; other columns of the input are kept, and added ones replace columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import map_text
from .words import SHINGLE, column_words, mix, shingles

FRACTION = 1 / 8
_SLICE = 1 << 18  # words


def limit_of(fraction: float) -> int:
    if not 0 < fraction <= 1:
        raise ValueError("the fraction is above 0 and at most 1")
    return min(2**64 - 1, int(fraction * 2**64))


def column_shingles(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, and the number of each one's text."""
    counts = np.diff(at)
    full = np.flatnonzero(counts >= SHINGLE)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    total = max(0, len(words) - SHINGLE + 1)
    with np.errstate(over="ignore"):
        hashes = np.zeros(total, np.uint64)
        for k in range(SHINGLE):
            hashes = hashes * np.uint64(0x100000001B3) + words[k : k + total]
        hashes = mix(hashes + np.uint64(SHINGLE))
    inside = np.zeros(total + 1, np.int64)  # shingles that begin and end in one text
    np.add.at(inside, at[full], 1)
    np.add.at(inside, at[full + 1] - SHINGLE + 1, -1)
    whole = hashes[np.cumsum(inside[:-1]) > 0]
    owners = np.repeat(full, counts[full] - SHINGLE + 1)
    few = [shingles(words[at[i] : at[i + 1]]) for i in short]
    return np.concatenate([whole, *few]), np.concatenate([owners, short])


def sketches(texts: pa.Array, fraction: float = FRACTION) -> pa.Array:
    """The fingerprint of each text: retained hashes in order, as signed numbers."""
    limit = np.uint64(limit_of(fraction))
    words, at = column_words(texts)
    held, names, low, n = [], [], 0, len(texts)
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(at, at[low] + _SLICE, side="right")) - 1))
        hashes, owner = column_shingles(words[at[low] : at[high]], at[low : high + 1] - at[low])
        least = np.full(high - low, 2**64 - 1, np.uint64)
        np.minimum.at(least, owner, hashes)
        keep = (hashes < limit) | (hashes == least[owner])
        held.append(hashes[keep])
        names.append(owner[keep] + low)
        low = high
    value = np.concatenate([np.zeros(0, np.uint64), *held]).view(np.int64)
    owner = np.concatenate([np.zeros(0, np.int64), *names])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    bounds = np.searchsorted(owner[new], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(value[new], pa.int64()))


def fingerprint(
    docs: DataFrame, text: str | list[str] = "text", name: str | list[str] = "sketch", fraction: float = FRACTION
) -> DataFrame:
    """``docs`` without the text, with its fingerprint as an array of longs. Several texts, in one pass, have a name each."""
    names = [name] if isinstance(name, str) else name
    added = ", ".join(f"`{n}` array<long>" for n in names)
    return map_text(docs, lambda *texts: [sketches(t, fraction) for t in texts], added, text)


def _unsigned(x: Column) -> Column:
    return x.bitwiseXOR(F.lit(-(2**63)))


def merged(sketch: Column | str, fraction: float = FRACTION) -> Column:
    """Aggregate: the fingerprint of the union of the shingles of all rows, from fingerprints of the same fraction."""
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_set(sketch))))
    return reduced(every, fraction)


def reduced(sketch: Column, fraction: float) -> Column:
    """A fingerprint at a smaller or equal fraction."""
    limit = limit_of(fraction) - 2**63
    least = F.array_min(F.transform(sketch, _unsigned))
    return F.filter(sketch, lambda x: (_unsigned(x) < F.lit(limit)) | (_unsigned(x) == least))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def _rated(a: Column, b: Column, of: Column) -> Column:
    empty = F.size(a) + F.size(b) == 0
    return F.when(empty, F.lit(1.0)).when(of == 0, F.lit(0.0)).otherwise(_shared(a, b) / of)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that are in ``b``."""
    return _rated(a, b, F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """The larger of both containments: the share of the smaller fingerprint that is in the other."""
    return _rated(a, b, F.least(F.size(a), F.size(b)))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of all shingles of both that both have."""
    return _rated(a, b, F.size(F.array_union(a, b)))


def text_of(sketch: Column) -> Column:
    """A fingerprint as hexadecimal digits, 16 for each hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")
