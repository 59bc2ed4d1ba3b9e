"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

1. Shingles of five words are weighted by (1 + log count) * idf. The idf is 1 for shingles in less than
   ``FREQUENT`` of all documents and falls with the logarithm, down to ``LEAST_IDF`` for a shingle in all of them.
   Their exact counts over all documents are found in two passes (slots of many shingles, then the shingles of the
   slots that count enough), both summed by Spark; only the final list reaches the driver.
2. Improved consistent weighted sampling draws ``BANDS * ROWS`` samples per document; equal bands make buckets.
3. Inside a bucket, documents whose samples agree often enough are joined by a spanning forest, never by all pairs.
   The forests' components are families.
4. Inside a family, pairs are compared exactly, the likeliest first; pairs already connected need no comparison.
   Pairs with a weighted Jaccard similarity of ``SIMILARITY`` link, and so do pairs that reach it with all weights
   equal, since the weights of a large group of copies must not hide it. Families and buckets above ``BLOCK``
   members are dealt to blocks: by the members' bands, so that alike members meet in most of the bands. The
   members with most edges of such a family's forest, where its origin is, join all of its blocks.
5. Members of one bucket that no block brought together are compared after that: the members of a crowded bucket are all
   in one family, and each of them outside the bucket's largest class so far meets all others, block by block. So no
   bucket loses a pair, whatever its size; what this takes grows with the members outside the largest class.

Equal texts are one node throughout, so thousands of copies cost one comparison. A document's class is the
smallest key of its component.

Defined results: a null text is alone in its class; texts without a word have no shingle and link only with
equal texts; rows with equal key and text are in one class; a null key is its own class' name only if all keys of
the class are null; an empty table gives an empty one; columns of the input are kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import skew
from ..operators.lineage import Scratch
from .graph import components, map_blocks
from .store import per_process
from .words import SHINGLE, column_words, mix, shingles

SIMILARITY = 0.8
BANDS, ROWS = 15, 3
FREQUENT = 0.01
LEAST_IDF = 0.5
LIKELY = 0.45  # share of equal samples from which a pair is looked at
BLOCK = 384
CENTERS = 8
CROSSED = 1 << 24  # with more pairs left to compare, crowds are dealt again first, as long as that adds links
CHUNK_SHINGLES = 1 << 20
SLOTS_LOG = 20  # slots of shingles that are counted first
GROUP_SHINGLES = 1 << 16
HOT_ROWS = 10_000  # a text, class or member with so many rows is looked up by many tasks

SIGNATURES = "doc_id long, digest binary, words long, bands array<long>, samples binary"


# -- weights ----------------------------------------------------------------------------------------


def distinct_shingles(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles in order and how often each occurs."""
    words, at = column_words(column)
    for i in range(len(column)):
        yield np.unique(shingles(words[at[i] : at[i + 1]], size), return_counts=True)


def _slots(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - SLOTS_LOG)).astype(np.int64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many times a shingle of each slot is in a document."""
    counts = np.zeros(1 << SLOTS_LOG, np.int64)
    for batch in batches:
        for values, _ in distinct_shingles(batch.column(0)):
            np.add.at(counts, _slots(values), 1)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["slot", "n"])


def frequent_counts(docs: DataFrame, total: int, text: str = "text") -> DataFrame:
    """``shingle`` and ``n``, the number of documents, of the shingles in at least ``FREQUENT`` of all documents.

    A shingle is in no more documents than its slot counts, so those of slots with too few are left out before the
    exact count. Both counts are summed by Spark.
    """
    texts = docs.select(text)
    slots = texts.mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    full = np.zeros(1 << SLOTS_LOG, bool)
    full[[r[0] for r in slots.where(F.col("n") >= FREQUENT * total).select("slot").collect()]] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(full))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = np.unpackbits(shared.value).view(bool)
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["shingle", "n"])

        for batch in batches:
            for values, _ in distinct_shingles(batch.column(0)):
                held.append(values[open_[_slots(values)]])
                size += len(held[-1])
                if size >= CHUNK_SHINGLES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counted = texts.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= FREQUENT * total)


def frequent_shingles(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles (sorted) and their idf, from exact counts over all documents.

    At most (mean shingles per document) / ``FREQUENT`` shingles can be frequent, whatever the number of documents, and
    only those are collected.
    """
    total = docs.count()
    rows = [tuple(r) for r in frequent_counts(docs, total, text).collect()]
    shingle, n = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.float64)
    order = np.argsort(shingle)
    shingle, n = shingle[order], n[order]
    rarity = np.clip(np.log(total / np.maximum(n, 1)) / -np.log(FREQUENT), 0, 1)
    idf = LEAST_IDF + (1 - LEAST_IDF) * rarity
    return shingle, idf.astype(np.float32)


def weights_of(values: np.ndarray, counts: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    known, idf = frequent
    weights = (1 + np.log(counts)).astype(np.float32)
    if len(known) and len(values):
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        hit = known[at] == values
        weights[hit] *= idf[at[hit]]
    return weights


# -- sampling ---------------------------------------------------------------------------------------

_SHIFT = 12
_LOWEST = int(np.float32(2.0**-33).view(np.uint32)) >> _SHIFT


def _gamma_quantile(u: np.ndarray) -> np.ndarray:
    """Quantile of the Gamma(2, 1) distribution by bisection on its distribution function."""
    low, high = np.zeros_like(u), np.full_like(u, 60.0)
    for _ in range(80):
        middle = (low + high) / 2
        below = -np.expm1(-middle) - middle * np.exp(-middle) < u
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of r for 16 bits, and of log c for uniform numbers by exponent and leading bits."""
    r = _gamma_quantile((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
    cells = np.arange(_LOWEST, (int(np.float32(1).view(np.uint32)) >> _SHIFT) + 1, dtype=np.uint32)
    u = (cells << np.uint32(_SHIFT) | np.uint32(1 << _SHIFT - 1)).view(np.float32).astype(np.float64)
    log_c = np.log(np.maximum(_gamma_quantile(np.minimum(u, 1 - 1e-9)), 1e-12)).astype(np.float32)
    return r, log_c


_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sample(values: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Consistent weighted samples of several sets laid one after the other: one row of 64-bit samples per set.

    Every set must have an element. For each sample: r and c from Gamma(2, 1) and b uniform by the element's hash,
    t = floor(log w / r + b), and the element with the least log c - r (t - b) - r is drawn, with its t.
    """
    table_r, table_c = per_process("sampling-tables", _tables)
    out = np.empty((len(starts), len(_SEEDS)), np.uint64)
    log_w = np.log(weights)
    heavy = np.flatnonzero(log_w)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
    for k, seed in enumerate(_SEEDS):
        bits = mix(values ^ seed)
        r = table_r[(bits & np.uint64(0xFFFF)).astype(np.int64)]
        b = ((bits >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
        u = ((bits >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)
        a = table_c[(u.view(np.uint32) >> np.uint32(_SHIFT)).astype(np.int64) - _LOWEST] - r * (1 - b)
        t = None
        if len(heavy):
            t = np.zeros(len(values), np.int64)
            t[heavy] = np.floor(log_w[heavy] / r[heavy] + b[heavy])
            a[heavy] -= r[heavy] * t[heavy]
        least = np.minimum.reduceat(a, starts)
        hits = np.flatnonzero(a == least[owner])
        first = hits[np.unique(owner[hits], return_index=True)[1]]
        drawn = values[first]
        if t is not None:
            drawn = drawn ^ mix(t[first].astype(np.uint64))
        out[:, k] = drawn
    return out


def bands_of(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    keys = np.zeros((len(samples), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            keys = mix(keys * np.uint64(0x100000001B3) + samples[:, k::ROWS] + np.uint64(k + 1))
    return keys


def signatures(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with a text: its digest, bands and samples; no bands where the text has no word."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    source = docs.where(F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("doc_id"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("digest"), F.col(text).alias("text")
    )

    def emit(rows: pa.RecordBatch, words: list[int], samples: np.ndarray, filled: np.ndarray) -> pa.RecordBatch:
        keys = bands_of(samples).view(np.int64)
        short = (mix(samples) >> np.uint64(32)).astype(np.uint32)
        full: list = [None] * rows.num_rows
        marks: list = [b""] * rows.num_rows
        for i, at in enumerate(filled):
            full[at], marks[at] = keys[i], short[i].tobytes()
        bands = pa.array([[] if f is None else f for f in full], pa.list_(pa.int64()))
        arrays = [rows.column(0), rows.column(1), pa.array(words, pa.int64()), bands, pa.array(marks, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "digest", "words", "bands", "samples"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            start, sets, filled, counts, held = 0, [], [], [], 0

            def flush(end: int) -> pa.RecordBatch:
                if sets:
                    sizes = [len(v) for v, _ in sets]
                    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
                    drawn = sample(np.concatenate([v for v, _ in sets]), np.concatenate([w for _, w in sets]), starts)
                else:
                    drawn = np.zeros((0, BANDS * ROWS), np.uint64)
                return emit(batch.slice(start, end - start), counts, drawn, np.array(filled, np.int64))

            for i, (values, times) in enumerate(distinct_shingles(batch.column(2))):
                counts.append(len(values))
                if len(values):
                    filled.append(i - start)
                    sets.append((values, weights_of(values, times, known)))
                    held += len(values)
                if held >= GROUP_SHINGLES:
                    yield flush(i + 1)
                    start, sets, filled, counts, held = i + 1, [], [], [], 0
            if counts:
                yield flush(batch.num_rows)

    return source.mapInArrow(run, SIGNATURES)


# -- families ---------------------------------------------------------------------------------------


class Forest:
    """Union-find over the members of one block."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.trees = n

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.trees -= 1
        return a != b


def likely_pairs(samples: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of a block whose samples agree in at least ``LIKELY``, the most alike first."""
    n = len(samples)
    agree = np.zeros((n, n), np.int16)
    for k in range(samples.shape[1]):
        agree += samples[:, None, k] == samples[None, :, k]
    i, j = np.nonzero(np.triu(agree >= LIKELY * samples.shape[1], 1))
    order = np.argsort(-agree[i, j], kind="stable")
    return zip(i[order].tolist(), j[order].tolist())


EDGES = "a binary, b binary"


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _forest_of_bucket(block: pa.Table) -> Iterator[pa.RecordBatch]:
    if block.num_rows < 2:
        return
    nodes = block.column("node").to_pylist()
    samples = np.frombuffer(b"".join(block.column("samples").to_pylist()), np.uint32).reshape(len(nodes), -1)
    forest, pairs = Forest(len(nodes)), []
    for i, j in likely_pairs(samples):
        if forest.join(i, j):
            pairs.append((nodes[i], nodes[j]))
            if forest.trees == 1:
                break
    if pairs:
        yield _edges(pairs)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Weighted and plain Jaccard similarity of two weighted sets."""
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(at_a):
        return 0.0, 0.0
    least = float(np.minimum(a[1][at_a], b[1][at_b]).sum(dtype=np.float64))
    both = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - least
    return least / both, len(at_a) / (len(a[0]) + len(b[0]) - len(at_a))


def _samples(block: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(block.column("samples").to_pylist()), np.uint32).reshape(block.num_rows, -1)


def _linked(
    block: pa.Table, candidates: Callable[[], Iterable[tuple[int, int]]], known: tuple[np.ndarray, np.ndarray], threshold: float
) -> Iterator[pa.RecordBatch]:
    """Links among the candidate pairs of a block, without those that connect what is connected already."""
    nodes = block.column("node").to_pylist()
    forest, pairs = Forest(len(nodes)), []
    leader: dict[bytes, int] = {}
    for i, label in enumerate(block.column("label").to_pylist()):  # what earlier rounds have linked
        forest.join(i, leader.setdefault(label, i))
    if forest.trees == 1:
        return
    sets = []
    for chunk in block.column("text").chunks:
        sets += [(v, weights_of(v, t, known)) for v, t in distinct_shingles(chunk)]
    sizes = np.array([len(v) for v, _ in sets], np.float64)
    totals = np.array([w.sum(dtype=np.float64) for _, w in sets])
    for i, j in candidates():
        if forest.trees == 1:
            break
        if forest.root(i) == forest.root(j):
            continue
        # No similarity is above the ratio of the sizes.
        if max(min(sizes[i], sizes[j]) / max(sizes[i], sizes[j]), min(totals[i], totals[j]) / max(totals[i], totals[j])) < threshold:
            continue
        if max(similarity(sets[i], sets[j])) >= threshold:
            forest.join(i, j)
            pairs.append((nodes[i], nodes[j]))
    if pairs:
        yield _edges(pairs)


def verified_blocks(members: DataFrame, frequent: tuple[np.ndarray, np.ndarray], threshold: float) -> DataFrame:
    """Links that connect the members of each block as far as exact comparisons allow."""
    shared = members.sparkSession.sparkContext.broadcast(frequent)

    def compare(block: pa.Table) -> Iterator[pa.RecordBatch]:
        if block.num_rows < 2:
            return
        own = {node: i for i, node in enumerate(block.column("node").to_pylist())}  # a center may be there twice
        block = block.take(pa.array(list(own.values())))
        yield from _linked(block, lambda: likely_pairs(_samples(block)), shared.value, threshold)

    return map_blocks(members, "block", compare, EDGES)


def _band_keys(rows: DataFrame, *kept: str) -> DataFrame:
    """Each row once per band, with the band's number and key."""
    return rows.select(*kept, F.posexplode("bands").alias("band", "band_key"))


def bucket_edges(nodes: DataFrame, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """Forests of the nodes that share a bucket and agree in enough samples; and edges that keep each crowded bucket together.

    Members of a crowded bucket are dealt to blocks here, and those of different blocks do not meet. So all of them are
    in the family of its smallest member, where ``crossing_blocks`` brings together who has not met.
    """
    keyed = _band_keys(nodes, "node").withColumn("bucket", F.xxhash64("band", "band_key"))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least"))
    sizes = tables.write(sizes.where("size > 1"), "bucket-sizes")
    crowded = keyed.join(sizes.drop("least"), "bucket")
    # A large bucket is dealt to blocks by a hash that differs from band to band.
    part = F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("size") / BLOCK).cast("long"))
    crowded = crowded.select("node", F.xxhash64("bucket", part).alias("block"))
    # A forest of one band says little more than that of another: a node brings its samples to each of its blocks.
    marked = crowded.join(nodes.select("node", "samples"), "node")
    forests = tables.write(map_blocks(marked, "block", _forest_of_bucket, EDGES), "bucket-edges")
    large = sizes.where(F.col("size") > BLOCK).select("bucket", F.col("least").alias("a"))
    whole = keyed.select("bucket", F.col("node").alias("b")).join(_small(large), "bucket").where("a <> b").select("a", "b")
    return forests, tables.write(whole.distinct(), "bucket-crowds")


def centers(large: DataFrame, edges: DataFrame) -> DataFrame:
    """The members with most edges of each large family."""
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node")))
    degrees = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    rank = F.row_number().over(W.partitionBy("component").orderBy(F.col("degree").desc(), "node"))
    # Only the best of many members are ranked, so a large family is no single sorted group.
    ranked = large.join(degrees, "node").select("component", "node", "doc_id", "samples", rank.alias("_rank"))
    return ranked.where(F.col("_rank") <= CENTERS).drop("_rank")


def band_groups(members: DataFrame, tables: Scratch, round_: int) -> DataFrame:
    """Members of large families once per band, narrow: who shares it (``g1``), and who shares a second band as well (``g2``)."""
    pairs = f"transform(sequence(0, {BANDS - 1}), i -> struct(i as band, bands[i] as k1, bands[(i + {1 + round_}) % {BANDS}] as k2))"
    keyed = members.select("node", "component", F.xxhash64("label").alias("label"), F.explode(F.expr(pairs)).alias("b"))
    one = F.xxhash64("component", "b.band", "b.k1").alias("g1")
    keyed = keyed.select("node", "component", "label", "b.band", one, F.xxhash64("component", "b.band", "b.k1", "b.k2").alias("g2"))
    return tables.write(keyed, f"keyed-{round_}")


def large_blocks(keyed: DataFrame, tables: Scratch, round_: int) -> DataFrame:
    """Blocks in which the members of large families meet: ``component``, ``node``, ``block``.

    Members meet band by band. A band shared by too many is split by a second band, in each round another one, and what is
    still too large by a hash. After the first round only such crowds are dealt again, as far as their members have
    different labels: the others have been compared completely. All rows here are narrow.
    """
    mixed = F.min("label") != F.max("label")
    first = keyed.groupBy(F.col("g1").alias("_g1")).agg(F.count(F.lit(1)).alias("n1"), mixed.alias("_mixed"))
    second = keyed.groupBy(F.col("g2").alias("_g2")).agg(F.count(F.lit(1)).alias("n2"), mixed.alias("_mixed"))
    if round_:
        first, second = first.where((F.col("n1") > BLOCK) & F.col("_mixed")), second.where("_mixed")
    crowds = {g: skew.heavy_keys(keyed, g, HOT_ROWS) for g in ("g1", "g2")}
    counted = skew.lookup(keyed, first.drop("_mixed"), "g1", "_g1", ["node"], crowds["g1"], "inner")
    counted = skew.lookup(counted, second.drop("_mixed"), "g2", "_g2", ["node"], crowds["g2"], "inner")
    split = F.col("n1") > BLOCK
    crowd = F.when(split, F.col("n2")).otherwise(F.col("n1"))
    part = F.pmod(F.xxhash64("node", "band", F.lit(round_)), F.ceil(crowd / BLOCK).cast("long"))
    block = F.xxhash64("g1", F.when(split, F.col("g2")), part, F.lit(round_)).alias("block")
    return tables.write(counted.where(crowd > 1).select("component", "node", block), f"dealt-{round_}")


def mixed_crowds(keyed: DataFrame) -> DataFrame:
    """Bands shared by more members than a block has, with several labels: members, largest label, members without it."""
    labels = keyed.groupBy("g1", "label").agg(F.count(F.lit(1)).alias("n"))
    main = F.max_by("label", F.struct("n", "label")).alias("main")
    crowds = labels.groupBy(F.col("g1").alias("_g1")).agg(F.sum("n").alias("size"), main, (F.sum("n") - F.max("n")).alias("others"))
    return crowds.where((F.col("size") > BLOCK) & (F.col("others") > 0))


CROSSING = "node binary, block long, band int, other boolean, asks boolean"


def crossing_blocks(keyed: DataFrame, crowds: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every member of a mixed crowd without its largest label (``asks``) beside every member of the crowd.

    Both sides are dealt to parts of half a block, and each part of the one meets each part of the other. Rows of members
    that have no likely partner with another label in a block are left out of it.
    """
    often = skew.heavy_keys(keyed, "g1", HOT_ROWS)
    rows = skew.lookup(keyed.drop("g2", "component"), crowds, "g1", "_g1", ["node"], often, "inner")
    rows = rows.join(nodes.select("node", "samples"), "node").withColumn("other", F.col("label") != F.col("main"))
    asking, asked = (F.greatest(F.lit(1), F.ceil(F.col(n) / (BLOCK // 2))).cast("long") for n in ("others", "size"))

    def side(members: DataFrame, asks: bool) -> DataFrame:
        parts, opposite = (asking, asked) if asks else (asked, asking)
        dealt = members.select("*", F.pmod(F.xxhash64("node", F.lit(asks)), parts).alias("_own"), F.explode(F.sequence(F.lit(0), opposite - 1)).alias("_met"))
        block = F.xxhash64("g1", *(("_own", "_met") if asks else ("_met", "_own"))).alias("block")
        return dealt.select("node", "label", "samples", "band", "other", F.lit(asks).alias("asks"), block)

    def likely(block: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j = crossed_pairs(block)
        if len(i):
            some = block.take(pa.array(np.unique(np.concatenate([i, j]))))
            yield from some.select(["node", "block", "band", "other", "asks"]).combine_chunks().to_batches()

    return map_blocks(side(rows.where("other"), True).unionByName(side(rows, False)), "block", likely, CROSSING)


def crossed_pairs(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Likely pairs, the most alike first, of an asking and an asked row with different labels.

    A pair counts in the first of the bands it shares, and two members that both ask count once.
    """
    asks = np.array(block.column("asks").to_pylist(), bool)
    left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
    samples, band = _samples(block), block.column("band")[0].as_py()
    agree = np.zeros((len(left), len(right)), np.int16)
    before = np.zeros(agree.shape, bool)
    for k in range(BANDS):
        same = np.ones(agree.shape, bool)
        for column in range(k * ROWS, (k + 1) * ROWS):
            equal = samples[left, column][:, None] == samples[right, column][None, :]
            agree += equal
            same &= equal
        if k < band:
            before |= same
    label = np.unique(np.array(block.column("label").to_pylist()), return_inverse=True)[1]
    place = np.unique(np.array(block.column("node").to_pylist(), "S16"), return_inverse=True)[1]
    twice = np.array(block.column("other").to_pylist(), bool)[right][None, :] & (place[left][:, None] > place[right][None, :])
    wanted = (agree >= LIKELY * samples.shape[1]) & ~before & ~twice & (label[left][:, None] != label[right][None, :])
    i, j = np.nonzero(wanted)
    order = np.argsort(-agree[i, j], kind="stable")
    return left[i[order]], right[j[order]]


def verified_crossings(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray], threshold: float) -> DataFrame:
    """Links between members that only ``crossing_blocks`` brings together."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def compare(block: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from _linked(block, lambda: zip(*(side.tolist() for side in crossed_pairs(block))), shared.value, threshold)

    return map_blocks(rows, "block", compare, EDGES)


def _small(df: DataFrame) -> DataFrame:
    """Marked for a broadcast if it is measured to be small."""
    return F.broadcast(df) if skew.measured_bytes(df) <= skew.BROADCAST_BYTES else df


def member_texts(members: DataFrame, docs: DataFrame, tables: Scratch, key: str, text: str) -> DataFrame:
    """``_node``, ``samples`` and ``text`` of all members, stored. Texts move only if there are many members."""
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    wanted = members.select("node", "doc_id")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.unhex(F.md5(F.col("text").cast("binary"))) == F.col("node"))
    found = texts.join(_small(wanted), same).groupBy(F.col("node").alias("_node")).agg(F.first("text").alias("text"))
    samples = members.select(F.col("node").alias("_of"), "samples")
    return tables.write(found.join(samples, F.col("_node") == F.col("_of")).drop("_of"), "texts")


def with_texts(blocks: DataFrame, labels: DataFrame, texts: DataFrame, tables: Scratch, round_: int) -> DataFrame:
    """The rows of all blocks (``node``, ``block`` and more) with samples, labels (``node``, ``label``) and texts."""
    nodes = _small(tables.write(blocks.select("node").distinct(), f"nodes-{round_}"))
    own = texts.join(nodes, F.col("_node") == F.col("node"), "left_semi")
    own = own.join(labels.select("node", "label"), F.col("_node") == F.col("node")).drop("node")
    # A center is in all blocks of its family, so it is looked up by many tasks.
    often = skew.heavy_keys(blocks, "node", HOT_ROWS)
    own = tables.write(own, f"texts-{round_}")
    return skew.lookup(blocks, own, "node", "_node", ["block"], often, "inner")


def linked_nodes(
    docs: DataFrame,
    nodes: DataFrame,
    frequent: tuple[np.ndarray, np.ndarray],
    tables: Scratch,
    threshold: float,
    key: str,
    text: str,
) -> DataFrame:
    """Components (``node``, ``component``) of the verified links between different texts.

    Large families are compared in blocks, then exactly across them. While there would be more than ``CROSSED`` pairs to
    compare, they are dealt to blocks again by other pairs of bands, as long as that adds links.
    """
    edges, crowds = bucket_edges(nodes, tables)
    member = components(edges.union(crowds), tables, "families")
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    member = tables.write(member.join(sizes, "component").join(nodes, "node"), "members").withColumn("label", F.col("node"))
    blocks = member.where(F.col("size") <= BLOCK).select("node", F.xxhash64("component").alias("block"))
    large = member.where(F.col("size") > BLOCK)
    crowded = not large.isEmpty()
    if crowded:
        dealt = large_blocks(band_groups(large, tables, 0), tables, 0)
        every = dealt.select("component", "block").distinct()
        added = centers(large, edges).join(every, "component")
        blocks = blocks.unionByName(dealt.select("node", "block")).unionByName(added.select("node", "block"))
    blocks = tables.write(blocks, "blocks-0")
    texts = member_texts(member, docs, tables, key, text)
    often = skew.heavy_keys(blocks, "node", HOT_ROWS)  # a center is in all blocks of its family
    full = skew.lookup(blocks, texts.withColumn("label", F.col("_node")), "node", "_node", ["block"], often, "inner")
    found = tables.write(verified_blocks(full, frequent, threshold), "links-0")
    tables.drop("bucket-sizes", "bucket-edges", "bucket-crowds", "keyed-0", "dealt-0", "blocks-0")
    linked = components(found, tables, "linked-0")
    for round_ in range(1, BANDS - 1 if crowded else 1):
        names = linked.withColumnRenamed("component", "_label")
        labelled = large.drop("label").join(names, "node", "left").withColumn("label", F.coalesce("_label", "node"))
        keyed = band_groups(labelled, tables, round_)
        left = tables.write(mixed_crowds(keyed), f"crowds-{round_}")
        pairs = left.agg(F.sum(F.col("others") * F.col("size"))).first()[0]
        if not pairs:
            break
        last = pairs <= CROSSED or round_ == BANDS - 2
        if not last:
            dealt = large_blocks(keyed, tables, round_)
            full = with_texts(dealt.select("node", "block"), labelled, texts, tables, round_)
            more = tables.write(verified_blocks(full, frequent, threshold), f"links-{round_}")
            last = more.isEmpty()
        if last:
            met = tables.write(crossing_blocks(keyed, left, large), "crossing")
            if met.isEmpty():
                break
            full = with_texts(met, labelled, texts, tables, BANDS)
            more = tables.write(verified_crossings(full, frequent, threshold), "links-crossed")
        tables.drop("crossing", *[f"{table}-{n}" for table in ("keyed", "crowds", "dealt", "nodes", "texts") for n in (round_, BANDS)])
        if not more.isEmpty():
            found = found.union(more)
            linked = components(found, tables, f"linked-{round_}")
        if last:
            break
    return linked


def classes(
    docs: DataFrame, tables: Scratch, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY
) -> DataFrame:
    """``doc_id``, ``digest``, ``class_id`` and ``class_size`` of every row; the digest is null for null texts."""
    others = set(tables.written)
    frequent = frequent_shingles(docs, text)
    signed = tables.write(signatures(docs, frequent, key, text), "signatures")
    nodes = signed.groupBy(F.col("digest").alias("node")).agg(
        F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("samples").alias("samples")
    )
    nodes = tables.write(nodes, "nodes")
    linked = linked_nodes(docs, nodes.where(F.size("bands") > 0), frequent, tables, threshold, key, text)
    named = nodes.select("node", "doc_id").join(linked, "node", "left")
    named = tables.write(named.select("node", "doc_id", F.coalesce("component", "node").alias("component")), "named")
    names = named.groupBy(F.col("component").alias("_component")).agg(F.min("doc_id").alias("class_id"))
    often = skew.heavy_keys(named, "component", HOT_ROWS)
    by_digest = skew.lookup(named, names, "component", "_component", ["node"], often, "inner")
    by_digest = by_digest.select(F.col("node").alias("_digest"), "component", "class_id")
    # Copies of one text, and members of one class, may be a large share of all rows.
    often = skew.heavy_keys(signed, "digest", HOT_ROWS)
    rows = skew.lookup(signed.select("doc_id", "digest"), by_digest, "digest", "_digest", ["doc_id"], often, "inner")
    rows = tables.write(rows, "rows")
    counted = rows.groupBy("component").agg(F.count(F.lit(1)).alias("class_size"))
    counted = tables.write(counted.withColumnRenamed("component", "_component"), "class-sizes")
    tables.drop(*(set(tables.written) - others - {"rows", "class-sizes"}))
    often = skew.heavy_keys(rows, "component", HOT_ROWS)
    found = skew.lookup(rows, counted, "component", "_component", ["doc_id"], often, "inner")
    found = found.select("doc_id", "digest", "class_id", "class_size")
    null_texts = docs.where(F.col(text).isNull()).select(
        F.col(key).cast("long").alias("doc_id"),
        F.lit(None).cast("binary").alias("digest"),
        F.col(key).cast("long").alias("class_id"),
        F.lit(1).cast("long").alias("class_size"),
    )
    return found.unionByName(null_texts)


def deduplicate(docs: DataFrame, tables: Scratch, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The documents without near-duplicates: of each class the row with the smallest key stays, once.

    Rows with null texts all stay.
    """
    row = F.struct(*docs.columns).alias("row")
    packed = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), row)
    others = set(tables.written)
    found = tables.write(classes(packed, tables, threshold=threshold), "classes")
    tables.drop(*(set(tables.written) - others - {"classes"}))
    # One key for digest and document: the rows, with their texts, are shuffled by it once for both the join and the last step.
    place = F.concat("digest", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("place")
    keep = found.where(F.col("digest").isNotNull()).groupBy("class_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("k")
    )
    keep = keep.select("k.doc_id", "k.digest").select(place)
    marked = packed.where(F.col("text").isNotNull()).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    left = marked.select(place, "row").join(keep, "place", "left_semi").dropDuplicates(["place"]).select("row")
    return left.unionByName(packed.where(F.col("text").isNull()).select("row")).select("row.*")
