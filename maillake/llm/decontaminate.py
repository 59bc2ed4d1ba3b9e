"""Benchmark decontamination by latent semantic retrieval.

1. Words are hashed to ``TERMS`` terms; document frequencies are counted over all documents.
2. A latent space is fitted on all passages of the documents and of the benchmark: randomised SVD of their TF-IDF
   rows, the products with the matrix summed by Spark, only matrices of ``TERMS`` times ``RANK`` and smaller on the
   driver. Coordinates are scaled to unit variance.
3. Every document is cut to overlapping windows. Windows with a high cosine to a benchmark passage are candidates.
   Every window is compared with every passage.
4. A candidate is dropped if it cannot pass what follows: of an item's words at most ``1 - PARAPHRASE`` may be missing, so
   of its rarest words, a few more than that, some are around the candidate. This bound loses nothing.
5. Around a candidate the longest common subsequence with the item's words is measured. A document holds an item if
   most of its words are there in order, or fewer (a paraphrase) but with the whole answer: what follows an answer
   mark in the item, or else its last sentence.

Defined results: null texts and texts without a word hold nothing; items without a word are never found; repeated
items are found each; repeated rows are judged alike; empty tables give no findings; columns of the input are kept,
and the added ``item_ids`` and ``overlap`` replace columns of the same name. Items are looked for by
passages of about ``WINDOW`` words and measured whole. Items come in blocks of ``BLOCK_ITEMS``, so what is
is handled at once is bounded; a worker holds about 1 KB for each item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import Scratch
from .store import map_text
from .words import column_words

TERMS_LOG = 15
TERMS = 1 << TERMS_LOG
RANK = 64
EXTRA = 8
PASSES = 2  # power iterations
PASSAGE = 48  # words of a passage of the fit; the last one of a text may have fewer
STEP = 8  # windows begin at multiples of so many words
SPAN = 3  # steps of a window
WINDOW = STEP * SPAN
CLOSE = 0.3  # cosine that makes a candidate; by measured recall of planted paraphrases, see the README
WHOLE = 0.8  # share of an item's words that makes a finding
PARAPHRASE = 0.6  # the same, if the answer is there
LEAST_ANSWER = 3
BLOCK_ITEMS = 4096
SLICE_WORDS = 1 << 16
SLICE_WINDOWS = 1 << 12
SLICE_PASSAGES = 1 << 7
CHUNKS = 16
BLOCK_PASSAGES = 1 << 14  # passages multiplied at once
PARTS = 4  # tasks that multiply the passages, and one more for each TASK_WORDS; each gives a matrix of TERMS times RANK
TASK_WORDS = 1 << 24
STORED = "term long, n long, terms binary, times binary, sizes binary"
ADDED = "item_ids array<long>, overlap double"
_ANSWER = re.compile(r"(?:^|\n|[.!?]\s)\s*(?:answer|a)\s*:\s*", re.I)
_SENTENCE = re.compile(r"[.!?\n]+\s*")


def terms_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - TERMS_LOG)).astype(np.int64)


# -- the latent space -------------------------------------------------------------------------------


def passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """All passages of all texts, and the documents per term, from one reading of the texts.

    A row is a term (or ``TERMS``, for the documents, or one more, for their words) and its number ``n``, or a block of
    passages: their terms one after the other, how often each is there, and how many each passage has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(TERMS + 2, np.int64)
        for batch in batches:
            words, at = column_words(batch.column(0))
            counts[TERMS] += batch.num_rows
            counts[TERMS + 1] += len(words)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(at))
            # Numbers of 16 bits are sorted by digits, and stay in the order of the texts.
            terms = terms_of(words).astype(np.uint16)
            order = np.argsort(terms, kind="stable")
            ranked, owner = terms[order], owner[order]
            new = np.ones(len(terms), bool)
            new[1:] = (ranked[1:] != ranked[:-1]) | (owner[1:] != owner[:-1])
            counts[:TERMS] += np.bincount(ranked[new], minlength=TERMS)
            for block in passage_blocks(terms, at):
                data = [pa.array([part.tobytes()], pa.binary()) for part in block]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *data], names=names)
        some = np.flatnonzero(counts)
        none = pa.nulls(len(some), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), none, none, none], names=names)

    names = [field.split(" ")[0] for field in STORED.split(", ")]
    return docs.select(text).mapInArrow(run, STORED)


def passage_blocks(terms: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each text cut to passages: distinct terms of each one, how often they are there, and terms per passage."""
    per = -(-np.diff(at) // PASSAGE)
    first = np.concatenate([[0], np.cumsum(per)])
    owner = np.repeat(np.arange(len(per)), per)
    cuts = np.append(at[owner] + PASSAGE * (np.arange(first[-1]) - first[owner]), len(terms))
    for low in range(0, len(cuts) - 1, BLOCK_PASSAGES):
        own = cuts[low : low + BLOCK_PASSAGES + 1]
        number = np.repeat(np.arange(len(own) - 1, dtype=np.uint32), np.diff(own))
        keys = np.sort(number << np.uint32(TERMS_LOG) | terms[own[0] : own[-1]])
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        times = np.diff(np.append(new, len(keys)))
        keys = keys[new]
        sizes = np.bincount(keys >> np.uint32(TERMS_LOG), minlength=len(own) - 1)
        yield (keys & np.uint32(TERMS - 1)).astype(np.uint16), times.astype(np.uint8), sizes.astype(np.uint8)


def term_counts(stored: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents per term, number of documents, number of words: over all documents."""
    counts = np.zeros(TERMS + 2, np.int64)
    summed = stored.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
    for term, n in summed.collect():  # at most TERMS + 2 rows
        counts[term] = n
    return counts[:TERMS], int(counts[TERMS]), int(counts[TERMS + 1])


def idf_of(counts: np.ndarray, docs: int) -> np.ndarray:
    return np.log((docs + 1) / (counts + 1)).astype(np.float32) + np.float32(0.1)


_TIMES = (1 + np.log(np.arange(1, PASSAGE + 1))).astype(np.float32)


def tfidf(terms: np.ndarray, times: np.ndarray, sizes: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of the terms of passages as sparse rows of length 1."""
    values = _TIMES[times - 1] * idf[terms]
    squares = np.add.reduceat(values * values, np.cumsum(sizes) - sizes)
    return values / np.repeat(np.sqrt(squares), sizes)


def add_product(out: np.ndarray, terms: np.ndarray, weights: np.ndarray, sizes: np.ndarray, q: np.ndarray) -> None:
    """Add A'AQ to ``out``, for the passages A of a block.

    Rows of Q, and then of AQ, are gathered to small matrices, many of which are multiplied in one call: those of a
    passage first, then those of a term, cut to pieces of the same length.
    """
    width = q.shape[1]
    start = np.cumsum(sizes) - sizes
    product = np.empty((len(sizes), 1, width), np.float32)
    for low in range(0, len(sizes), SLICE_PASSAGES):
        own = sizes[low : low + SLICE_PASSAGES]
        span = slice(start[low], start[low] + own.sum())
        there = np.arange(PASSAGE) < own[:, None]
        places, values = np.zeros(there.shape, np.int64), np.zeros(there.shape, np.float32)
        places[there], values[there] = terms[span], weights[span]
        rows = q.take(places.ravel(), axis=0, mode="clip").reshape(-1, PASSAGE, width)
        np.matmul(values[:, None, :], rows, out=product[low : low + SLICE_PASSAGES])
    product = product[:, 0]
    order = np.argsort(terms, kind="stable")
    ranked = terms[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    many = np.diff(np.append(first, len(ranked)))
    piece = int(min(16, max(1, len(ranked) // len(first))))
    pieces = -(-many // piece)
    begin = np.cumsum(pieces) - pieces
    place = np.arange(len(ranked)) + np.repeat(begin * piece - first, many)
    places, values = np.zeros(pieces.sum() * piece, np.int64), np.zeros(pieces.sum() * piece, np.float32)
    places[place], values[place] = np.repeat(np.arange(len(sizes)), sizes)[order], weights[order]
    values = values.reshape(-1, 1, piece)
    sums = np.empty((len(values), 1, width), np.float32)
    step = SLICE_WINDOWS // piece
    for low in range(0, len(values), step):
        rows = product.take(places[low * piece : (low + step) * piece], axis=0, mode="clip").reshape(-1, piece, width)
        np.matmul(values[low : low + step], rows, out=sums[low : low + step])
    out[ranked[first]] += np.add.reduceat(sums[:, 0], begin, axis=0)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stored blocks, small ones put together: terms, times and sizes."""
    held: list[tuple[np.ndarray, ...]] = []
    passages = 0
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            block = tuple(np.frombuffer(data, kind) for data, kind in zip(row, (np.uint16, np.uint8, np.uint8)))
            held.append(block)
            passages += len(block[2])
            if passages >= BLOCK_PASSAGES:
                yield tuple(np.concatenate(parts) for parts in zip(*held))
                held, passages = [], 0
    if held:
        yield tuple(np.concatenate(parts) for parts in zip(*held))


def _gram_product(rows: DataFrame, idf: np.ndarray, basis: np.ndarray, tables: Scratch, name: str) -> np.ndarray:
    """A'AQ of the TF-IDF rows A of all stored passages: each task multiplies its rows, Spark sums the parts by ranges of terms."""
    shared = rows.sparkSession.sparkContext.broadcast((np.ascontiguousarray(basis), idf))  # TERMS times RANK + EXTRA
    width, size = basis.shape[1], TERMS // CHUNKS

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = shared.value
        out = np.zeros(q.shape, np.float32)
        for terms, times, sizes in _merged(batches):
            sizes = sizes.astype(np.int64)
            add_product(out, terms, tfidf(terms, times, sizes, own), sizes, q)
        parts = [out[c * size : (c + 1) * size].tobytes() for c in range(CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=["c", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                total = totals.setdefault(c, np.zeros(size * width, np.float64))
                total += np.frombuffer(part.as_buffer(), np.float32)
        data = [total.astype(np.float32).tobytes() for total in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(data, pa.binary())], names=["c", "m"])

    parts = rows.mapInArrow(multiply, "c int, m binary").repartition(CHUNKS, "c")
    out = np.zeros(basis.shape, np.float32)
    for c, data in tables.write(parts.mapInArrow(add, "c int, m binary"), name).collect():
        out[c * size : (c + 1) * size] = np.frombuffer(data, np.float32).reshape(size, width)
    tables.drop(name)
    shared.destroy()
    return out


def latent_space(rows: DataFrame, idf: np.ndarray, tables: Scratch) -> np.ndarray:
    """Coordinates of each term: right singular vectors by randomised subspace iteration, over singular values."""
    q = np.random.default_rng(11).standard_normal((TERMS, RANK + EXTRA), dtype=np.float32)
    for i in range(PASSES):
        q = np.linalg.qr(_gram_product(rows, idf, q, tables, f"product-{i}"))[0].astype(np.float32)
    product = _gram_product(rows, idf, q, tables, f"product-{PASSES}")
    values, vectors = np.linalg.eigh((q.T @ product).astype(np.float64))
    order = np.argsort(values)[::-1][:RANK]
    top = max(float(values[order[0]]), 1e-12)
    good = [i for i in order if values[i] > 1e-6 * top]
    spread = np.sqrt(values[good])
    return (idf[:, None] * (q @ vectors[:, good]) / spread).astype(np.float32)


# -- items ------------------------------------------------------------------------------------------


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    answer: np.ndarray


@dataclass
class Rare:
    """Of each item's rarest words, the items that hold a word, and how many of them a finding has at least.

    ``words`` is sorted; the items of word i are ``items[first[i]:first[i + 1]]``. ``reach`` is how far, before its beginning
    and behind its end, an item is looked for.
    """

    words: np.ndarray
    first: np.ndarray
    items: np.ndarray
    least: np.ndarray
    sizes: np.ndarray
    reach: np.ndarray


@dataclass
class Queries:
    """Passages of a block of items: latent unit rows, item numbers and places in the item."""

    items: list[Item]
    rows: np.ndarray
    numbers: np.ndarray
    places: np.ndarray
    rare: Rare


def answer_of(text: str) -> str:
    """What follows an answer mark, else the last sentence."""
    marked = _ANSWER.split(text)
    if len(marked) > 1:
        return marked[-1]
    sentences = [s for s in _SENTENCE.split(text) if s.strip()]
    return sentences[-1] if len(sentences) > 1 else ""


def _hashed(texts: list[str]) -> list[np.ndarray]:
    words, at = column_words(pa.array(texts, pa.string()))
    return [words[a:b] for a, b in zip(at, at[1:])]


def items_of(rows: list[tuple[int, str | None]]) -> list[Item]:
    texts = [text or "" for _, text in rows]
    found = zip(rows, _hashed(texts), _hashed([answer_of(t) for t in texts]))
    return [Item(key, words, answer) for (key, _), words, answer in found if len(words)]


def passages_of(words: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """An item's passages and their places: even parts of about ``WINDOW`` words."""
    parts = max(1, round(len(words) / WINDOW))
    cuts = np.linspace(0, len(words), parts + 1).astype(int)
    return [(int(a), words[a:b]) for a, b in zip(cuts, cuts[1:])]


def reach_of(size: int) -> int:
    """How far before and behind its place an item is looked for: the misfit of a window, and some inserted words."""
    return WINDOW + size // 8


def rare_words(items: list[Item], idf: np.ndarray) -> Rare:
    """A finding has at least ``PARAPHRASE`` of an item's words. So it lacks at most ``spare`` of them, and of the
    ``spare + n`` rarest it has at least n."""
    pairs: set[tuple[int, int]] = set()
    least = []
    for number, item in enumerate(items):
        size = len(item.words)
        spare = size - int(np.ceil(PARAPHRASE * size - 1e-9))
        extra = min(size - spare, max(2, size // 8))
        order = np.argsort(-idf[terms_of(item.words)], kind="stable")
        pairs.update((int(w), number) for w in item.words[order[: spare + extra]])
        least.append(extra)
    listed = sorted(pairs)
    words, first = np.unique(np.array([w for w, _ in listed], np.uint64), return_index=True)
    sizes = np.array([len(i.words) for i in items], np.int64)
    return Rare(
        words,
        np.append(first, len(listed)).astype(np.int64),
        np.array([n for _, n in listed], np.int64),
        np.array(least, np.int64),
        sizes,
        np.array([reach_of(n) for n in sizes.tolist()], np.int64),
    )


def queries_of(items: list[Item], space: np.ndarray, idf: np.ndarray) -> Queries:
    """The items' passages in the latent space."""
    rows, numbers, places = [], [], []
    for number, item in enumerate(items):
        for at, words in passages_of(item.words):
            row = space[terms_of(words)].sum(0)
            size = np.linalg.norm(row)
            if size > 0:
                rows.append(row / size)
                numbers.append(number)
                places.append(at)
    matrix = np.stack(rows).astype(np.float32) if rows else np.zeros((0, space.shape[1]), np.float32)
    return Queries(items, matrix, np.array(numbers, int), np.array(places, int), rare_words(items, idf))


# -- windows and checks -----------------------------------------------------------------------------


def common_length(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence with a text of ``size`` words, given as masks of their places."""
    full = (1 << size) - 1
    row = full
    for word in words:
        mask = masks.get(word)
        if mask is not None:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def masks_of(words: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, word in enumerate(words.tolist()):
        masks[word] = masks.get(word, 0) | 1 << i
    return masks


def contains(words: list[int], part: list[int]) -> bool:
    n = len(part)
    return any(words[i : i + n] == part for i, w in enumerate(words[: len(words) - n + 1]) if w == part[0])


Found = dict[tuple[int, int], list[tuple[float, int, int]]]


@dataclass
class Slice:
    """Words of some texts, cut to blocks of ``STEP`` words that cross no border of texts.

    ``bounds`` are the places where the texts begin, and the end. A slice may be the inner part of a long text: then
    there are words before (``before``) or behind (``behind``) it.
    """

    words: np.ndarray
    bounds: np.ndarray
    before: bool = False
    behind: bool = False

    def __post_init__(self) -> None:
        blocks = -(-np.diff(self.bounds) // STEP)
        self.first = np.concatenate([[0], np.cumsum(blocks)])
        self.owner = np.repeat(np.arange(len(blocks)), blocks)
        self.starts = self.bounds[self.owner] + STEP * (np.arange(self.first[-1]) - self.first[self.owner])
        self.ends = np.minimum(self.starts + STEP, self.bounds[self.owner + 1])
        self.terms = terms_of(self.words)

    def rare_counts(self, rare: Rare) -> np.ndarray:
        """How many of an item's rare words there are in all blocks before each one."""
        marked = np.zeros(TERMS, bool)
        marked[terms_of(rare.words)] = True
        hit = np.flatnonzero(marked[self.terms])
        own = np.searchsorted(rare.words, self.words[hit])
        own[own == len(rare.words)] = 0
        same = rare.words[own] == self.words[hit] if len(rare.words) else np.zeros(0, bool)
        hit, own = hit[same], own[same]
        many = rare.first[own + 1] - rare.first[own]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        items = rare.items[np.repeat(rare.first[own], many) + inner]
        block = np.repeat(np.searchsorted(self.starts, hit, side="right") - 1, many)
        counts = np.zeros((len(self.starts) + 1, len(rare.least)), np.int32)
        np.add.at(counts, (block + 1, items), 1)
        return np.cumsum(counts, axis=0, out=counts)

    def possible(self, counts: np.ndarray, rare: Rare, block: np.ndarray, begin: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether an item that begins at ``begin``, in the text of ``block``, can be a finding by its rare words."""
        text = self.owner[block]
        low, high = self.bounds[text], self.bounds[text + 1]
        start, stop = begin - rare.reach[item], begin + rare.sizes[item] + rare.reach[item]
        outside = (self.before & (start < low)) | (self.behind & (stop > high))
        start, stop = np.clip(start, low, high - 1), np.clip(stop, low + 1, high)
        left = self.first[text] + (start - low) // STEP
        right = self.first[text] + (stop - 1 - low) // STEP + 1
        return outside | (counts[right, item] - counts[left, item] >= rare.least[item])


def candidates(part: Slice, space: np.ndarray, queries: Queries) -> Found:
    """For each text (by number) and item the candidate windows, as (-cosine, first word, place in the item)."""
    found: Found = {}
    blocks = len(part.starts)
    if not blocks or not len(queries.rows):
        return found
    counts = part.rare_counts(queries.rare)
    # A window is a block and the next ones of its text; the last windows of a text are part of the one before.
    first = part.first[part.owner]
    begin = np.flatnonzero((np.arange(blocks) <= part.first[part.owner + 1] - SPAN) | (np.arange(blocks) == first))
    stop = np.minimum(begin + SPAN, part.first[part.owner[begin] + 1])
    for low in range(0, len(begin), SLICE_WINDOWS):
        span = slice(low, low + SLICE_WINDOWS)
        _score(part, begin[span], stop[span], space, queries, counts, found)
    return found


def block_sums(part: Slice, low: int, high: int, space: np.ndarray) -> np.ndarray:
    """Sums of the coordinates of the words of each block, one place of the blocks after the other."""
    starts, sizes = part.starts[low:high], part.ends[low:high] - part.starts[low:high]
    terms = part.terms
    sums = space[terms[starts]]
    for k in range(1, STEP):
        longer = np.flatnonzero(sizes > k)
        if len(longer) == len(starts):
            sums += space[terms[starts + k]]
        else:
            sums[longer] += space[terms[starts[longer] + k]]
    return sums


def _score(part: Slice, begin: np.ndarray, stop: np.ndarray, space: np.ndarray, queries: Queries, counts: np.ndarray, found: Found) -> None:
    """Add the windows from block ``begin`` to before ``stop`` that are close to a passage."""
    low, high = int(begin[0]), int(stop[-1])
    sums = np.zeros((high - low + 1, space.shape[1]), np.float32)
    np.cumsum(block_sums(part, low, high, space), axis=0, out=sums[1:])
    window = sums[stop - low] - sums[begin - low]
    near = window @ queries.rows.T
    size = np.sqrt(np.einsum("ij,ij->i", window, window))
    w, q = np.divmod(np.flatnonzero(near >= np.maximum(CLOSE * size, 1e-6)[:, None]), near.shape[1])
    start, item = part.starts[begin[w]], queries.numbers[q]
    keep = part.possible(counts, queries.rare, begin[w], start - queries.places[q], item)
    w, q = w[keep], q[keep]
    cosine = (near[w, q] / size[w]).tolist()
    texts, starts = part.owner[begin[w]].tolist(), part.starts[begin[w]].tolist()
    numbers, places = queries.numbers[q].tolist(), queries.places[q].tolist()
    for c, text, at, number, spot in zip(cosine, texts, starts, numbers, places):
        found.setdefault((text, number), []).append((-c, at, spot))


def check(words: np.ndarray, low: int, high: int, item: Item, masks: dict[int, int], hits: list) -> float:
    """Share of the item's words found in order near the candidates; 0 if that is no finding.

    The text is ``words[low:high]``. The nearest candidates are looked at first.
    """
    size = len(item.words)
    seen: list[tuple[int, int]] = []
    for _, start, place in sorted(hits):
        begin = start - place
        if any(abs(begin - other) <= STEP for other, _ in seen):
            continue
        seen.append((begin, place))
        near = words[max(low, begin - reach_of(size)) : min(high, begin + size + reach_of(size))].tolist()
        share = common_length(masks, size, near) / size
        if share >= WHOLE:
            return share
        if share >= PARAPHRASE and len(item.answer) >= LEAST_ANSWER and contains(near, item.answer.tolist()):
            return share
    return 0.0


def judge(words: np.ndarray, at: np.ndarray, space: np.ndarray, queries: Queries, masks: dict[int, dict[int, int]]) -> tuple[list[list[int]], list[float]]:
    """Items of each text, whose words are ``words[at[i]:at[i + 1]]``, and the largest share. ``masks`` are kept for later calls."""
    texts = len(at) - 1
    found: list[list[int]] = [[] for _ in range(texts)]
    share = [0.0] * texts
    overlap = 2 * WINDOW
    i = 0
    while i < texts:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_WORDS, side="right")) - 1)
        j = min(j, texts)
        merged: Found = {}
        low = int(at[i])
        while True:  # one slice, or a long text in overlapping slices
            high = int(at[j]) if j > i + 1 else min(int(at[j]), low + SLICE_WORDS)
            bounds = np.clip(at[i : j + 1], low, high)
            part = Slice(words[low:high], bounds - low, low > at[i], high < at[j])
            for key, hits in candidates(part, space, queries).items():
                merged.setdefault(key, []).extend((c, start + low, place) for c, start, place in hits)
            if high >= at[j]:
                break
            low = high - overlap
        for (text, number), hits in merged.items():
            item = queries.items[number]
            if number not in masks:
                masks[number] = masks_of(item.words)
            own = check(words, int(at[i + text]), int(at[i + text + 1]), item, masks[number], hits)
            if own:
                found[i + text].append(item.item_id)
                share[i + text] = max(share[i + text], own)
        i = j
    return found, share


def find_items(docs: DataFrame, benchmark: DataFrame, tables: Scratch, text: str = "text", key: str = "item_id") -> DataFrame:
    """The documents with ``item_ids``, the benchmark items each holds, and ``overlap``, the largest share of an item."""
    bench = benchmark.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    stored = tables.write(passages(docs, text), "passages")
    counts, total, words = term_counts(stored)
    idf = idf_of(counts, total)
    rows = stored.unionByName(tables.write(passages(bench), "items")).where("terms is not null")
    space = latent_space(rows.select("terms", "times", "sizes").coalesce(PARTS + words // TASK_WORDS), idf, tables)
    tables.drop("passages", "items")
    blocks = max(1, -(-bench.count() // BLOCK_ITEMS))
    part = F.pmod(F.xxhash64("key", "text"), F.lit(blocks))
    context = docs.sparkSession.sparkContext
    shared_space = context.broadcast(space)
    shared = []
    for block in range(blocks):
        items = items_of(sorted((tuple(r) for r in bench.where(part == block).collect()), key=str))
        made = queries_of(items, space, idf)
        # Plain values, as classes of a broadcast would have to be installed on the executors.
        parts = [(i.item_id, i.words, i.answer) for i in made.items]
        shared.append(context.broadcast((parts, made.rows, made.numbers, made.places, tuple(vars(made.rare).values()))))
    held: dict[int, tuple[Queries, dict]] = {}

    def run(column: pa.Array) -> list[pa.Array]:
        words, at = column_words(column)
        found: list[list[int]] = [[] for _ in range(len(column))]
        share = np.zeros(len(column))
        for block, values in enumerate(shared):
            if block not in held:
                parts, rows, numbers, places, rare = values.value
                held[block] = Queries([Item(*p) for p in parts], rows, numbers, places, Rare(*rare)), {}
            own, most = judge(words, at, shared_space.value, *held[block])
            found = [a + b for a, b in zip(found, own)]
            share = np.maximum(share, most)
        return [pa.array([sorted(f) for f in found], pa.list_(pa.int64())), pa.array(share, pa.float64())]

    return map_text(docs, run, ADDED, text, keep=True)
