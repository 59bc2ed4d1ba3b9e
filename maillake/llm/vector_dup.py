"""Near-duplicate vectors by NN-descent.

1. Equal vectors of a label are one node. Random hyperplanes give every node a path per tree; runs of nodes that are
   neighbours in path order compare with each other and fill the first neighbour lists.
2. A round of descent brings the neighbours of each node (in both directions) together; they compare with each other,
   and every node keeps the best ``NEIGHBOURS`` it has met. Rounds end when few lists change. Of all pairs at the
   threshold that meet in a comparison a spanning forest is kept besides, so a full list cuts no group in two.
3. Pairs at the threshold are links; their components are found. A list whose last entry is at the threshold is full
   and may hide links to other components, so the nodes of full lists are compared exactly with those of other
   components: in balls of up to ``BLOCK`` members, leaving out balls that are too far apart for any link.
4. The list of a node in a component is enlarged to its whole component: a dense group saturates any fixed list. Balls that
   lie near enough as a whole are counted as a whole, others are compared exactly. Only counts leave a block, never pairs.
5. An audit compares ``AUDITED`` nodes with all nodes by brute force. While too few of their links are inside
   components, further trees and rounds are added; links that the audit finds are kept. If the recall stays below
   ``RECALL``, every component, of one node too, is compared with all others as in 3: slower, but exact.

Cosines are in double precision. Defined results: vectors that are null, empty, zero, of a null label, or with
null or non-finite components link with nothing; vectors of different length are not compared; repeated rows are
vectors of their own that link with each other; the component's name is its smallest key; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import skew
from ..operators.lineage import Scratch
from .graph import components, map_blocks

THRESHOLD = 0.93
NEIGHBOURS = 8
TREES = 6
PATH_BITS = 48
RUN = 128  # nodes compared with each other in path order
CROWD = 48  # neighbours compared with each other around a node
OFFERED = 4  # best others that a comparison offers each node
ROUNDS = 4
FEW = 0.02  # share of changed list places that ends the descent
BLOCK = 512
AUDITED = 1024
RECALL = 0.99
TRIES = 3
HOT_ROWS = 1_000  # a vector or component with so many rows is looked up by many tasks
PAIRS = "a binary, b binary, cosine double"
MET = PAIRS + ", forest boolean"


def unit_rows(raw: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes, with their length."""
    for batch in batches:
        keep, raw = [], []
        for i, (label, vector) in enumerate(zip(batch.column(1), batch.column(2))):
            if not (label.is_valid and vector.is_valid) or vector.values.null_count or not len(vector.values):
                continue
            row = vector.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zeros
            with np.errstate(over="ignore"):
                size = np.linalg.norm(row)
            if not np.isfinite(row).all() or not row.any():
                continue
            if not np.isfinite(size) or size < 1e-150:
                row = row / np.abs(row).max()
            keep.append(i)
            raw.append(row.tobytes())
        rows = batch.take(pa.array(keep, pa.int64()))
        arrays = [rows.column(0), rows.column(1).cast(pa.string()), pa.array(raw, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "vec"])


def paths_of(vecs: list[bytes], trees: int, first: int) -> np.ndarray:
    """One path per vector and tree: the sides of random hyperplanes, the first ones foremost."""
    paths = np.zeros((len(vecs), trees), np.int64)
    sizes = np.array([len(v) for v in vecs])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        rows = unit_rows([vecs[i] for i in at])
        for t in range(trees):
            planes = np.random.default_rng((first + t, size)).standard_normal((size // 8, PATH_BITS))
            # In this order neighbours in the list differ in late sides only, mostly in one.
            gray = np.logical_xor.accumulate(rows @ planes > 0, axis=1)
            paths[at, t] = gray @ (1 << np.arange(PATH_BITS - 1, -1, -1, dtype=np.int64))
    return paths


def with_paths(nodes: DataFrame, trees: int, first: int) -> DataFrame:
    """The nodes with one path per tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.array(list(paths_of(batch.column(2).to_pylist(), trees, first)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["node", "space", "vec", "paths"])

    return nodes.select("node", "space", "vec").mapInArrow(run, "node binary, space long, vec binary, paths array<long>")


def _forest(nodes: list[bytes], linked: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the linked nodes, from the smallest node of each tree."""
    left = linked.any(axis=1)
    ends: tuple[list[int], list[int]] = [], []
    for root in sorted(np.flatnonzero(left).tolist(), key=nodes.__getitem__):
        if not left[root]:
            continue
        left[root] = False
        open_ = [root]
        while open_:
            i = open_.pop()
            new = np.flatnonzero(linked[i] & left)
            left[new] = False
            open_ += new.tolist()
            ends[0].extend([i] * len(new))
            ends[1].extend(new.tolist())
    return ends


def _offers(nodes: list[bytes], rows: np.ndarray, most: int, threshold: float) -> pa.RecordBatch:
    """The best others of each node among these, as pairs, and a forest of all pairs at the threshold."""
    near = rows @ rows.T
    np.fill_diagonal(near, -2)
    most = min(most, len(nodes) - 1)
    best = np.argpartition(-near, most - 1, axis=1)[:, :most] if most < len(nodes) - 1 else np.argsort(-near, axis=1)[:, :most]
    a, b = _forest(nodes, near >= threshold)
    mine = np.concatenate([np.repeat(np.arange(len(nodes)), most), np.array(a, np.int64)])
    other = np.concatenate([best.ravel(), np.array(b, np.int64)])
    names = pa.array(nodes, pa.binary())
    forest = pa.array(np.arange(len(mine)) >= len(nodes) * most)
    arrays = [names.take(pa.array(mine)), names.take(pa.array(other)), pa.array(near[mine, other]), forest]
    return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "cosine", "forest"])


def _distinct(nodes: list[bytes], vecs: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    found = dict(zip(nodes, vecs))
    return list(found), list(found.values())


def tree_pairs(pathed: DataFrame, tree: int, threshold: float) -> DataFrame:
    """Comparisons of runs of nodes in the path order of a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[bytes] = []
        vecs: list[bytes] = []
        space = None
        for batch in batches:
            for node, own, vec in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if own != space or len(nodes) == RUN:
                    if len(nodes) > 1:
                        yield _offers(nodes, unit_rows(vecs), NEIGHBOURS, threshold)
                    nodes, vecs, space = [], [], own
                nodes.append(node)
                vecs.append(vec)
        if len(nodes) > 1:
            yield _offers(nodes, unit_rows(vecs), NEIGHBOURS, threshold)

    order = ["space", "path", "node"]
    dealt = pathed.select("node", "space", "vec", F.col("paths")[tree].alias("path"))
    parts = max(1, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, MET)


def best_lists(pairs: DataFrame) -> DataFrame:
    """The best neighbours of each node, by ``rank``, and the forests; pairs met twice count once."""
    once = pairs.groupBy("a", "b").agg(
        F.max("cosine").alias("cosine"), F.min("old").alias("old"), F.max("forest").alias("forest")
    )
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.col("cosine").desc(), "b"))
    return once.withColumn("rank", rank).where(F.col("forest") | (F.col("rank") <= NEIGHBOURS))


def descend(lists: DataFrame, nodes: DataFrame, round_: int, threshold: float) -> DataFrame:
    """One round: the neighbours around each node compare with each other."""
    best = lists.where(F.col("rank") <= NEIGHBOURS)
    around = best.select(F.col("a").alias("center"), F.col("b").alias("node"))
    around = around.union(best.select(F.col("b").alias("center"), F.col("a").alias("node"))).distinct()
    degrees = around.groupBy("center").agg(F.count(F.lit(1)).alias("degree"))
    # Around a much-listed node they meet in parts that change from round to round.
    part = F.pmod(F.xxhash64("center", "node", F.lit(round_)), F.ceil(F.col("degree") / CROWD).cast("long"))
    dealt = around.join(degrees, "center").select("node", F.xxhash64("center", part).alias("block"))
    full = dealt.join(nodes.select("node", "vec"), "node")

    def compare(block: pa.Table) -> Iterator[pa.RecordBatch]:
        own, vecs = _distinct(block.column("node").to_pylist(), block.column("vec").to_pylist())
        if len(own) > 1 and len({len(v) for v in vecs}) == 1:
            yield _offers(own, unit_rows(vecs), OFFERED, threshold)

    met = map_blocks(full, "block", compare, MET).withColumn("old", F.lit(False))
    return best_lists(lists.drop("rank").withColumn("old", F.lit(True)).unionByName(met))


def full_lists(lists: DataFrame) -> DataFrame:
    """The nodes whose last place is taken by a link."""
    return lists.where((F.col("rank") == NEIGHBOURS) & F.col("link")).select(F.col("a").alias("node"))


def _with_path(members: DataFrame) -> DataFrame:
    """Members with their path in the first tree."""
    names = [*members.columns, "path"]
    at = members.columns.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(at).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths_of(vecs, 1, 0)[:, 0])], names=names)

    return members.mapInArrow(run, T.StructType(members.schema.fields + [T.StructField("path", T.LongType())]))


def balls_of(members: DataFrame, tables: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """The members with their ``ball``, and the balls: ``ball``, ``space``, ``component``, ``center``, ``angle``, ``copies``.

    A component is dealt to balls of up to about ``BLOCK`` members by the first sides of their paths, so the members of
    a ball are near each other; what is still too many of one path is split by a hash.
    """
    stored = tables.write(_with_path(members), f"{name}-pathed")
    sizes = stored.groupBy(F.col("component").alias("_component")).agg(F.count(F.lit(1)).alias("size"))
    crowds = skew.heavy_keys(stored, "component", HOT_ROWS)
    own = skew.lookup(stored, sizes, "component", "_component", ["node"], crowds, "inner")
    sides = F.when(F.col("size") > BLOCK, F.least(F.ceil(F.log2(F.col("size") / BLOCK)) + 2, F.lit(PATH_BITS))).otherwise(0)
    own = own.withColumn("_sides", sides.cast("int"))
    cell = F.xxhash64("component", F.expr(f"shiftright(path, {PATH_BITS} - _sides)")).alias("cell")
    own = tables.write(own.select(*members.columns, cell), f"{name}-cells")
    counts = own.groupBy(F.col("cell").alias("_cell")).agg(F.count(F.lit(1)).alias("n"))
    own = skew.lookup(own, counts, "cell", "_cell", ["node"], skew.heavy_keys(own, "cell", HOT_ROWS), "inner")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK).cast("long"))
    own = tables.write(own.select(*members.columns, F.xxhash64("cell", part).alias("ball")), f"{name}-members")

    def middle(block: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = unit_rows(block.column("vec").to_pylist())
        center = rows.sum(axis=0)
        size = np.linalg.norm(center)
        center = center / size if size > 1e-9 else rows[0]
        angle = float(np.arccos(np.clip(rows @ center, -1, 1)).max())
        one = block.slice(0, 1)
        arrays = [one.column(n).combine_chunks() for n in ("ball", "space", "component")]
        copies = int(pc.sum(block.column("copies")).as_py())
        arrays += [pa.array([center.tobytes()], pa.binary()), pa.array([angle]), pa.array([copies])]
        yield pa.RecordBatch.from_arrays(arrays, names=["ball", "space", "component", "center", "angle", "copies"])

    schema = "ball long, space long, component binary, center binary, angle double, copies long"
    return own, tables.write(map_blocks(own, "ball", middle, schema), f"{name}-balls")


def ball_pairs(balls: DataFrame, threshold: float, within: bool) -> DataFrame:
    """Pairs of balls ``x`` < ``y`` that may hold a link: of one component (``within``, each ball with itself too), or of
    different components of one space. ``every`` tells that all their members are linked.

    Balls whose middles are further apart than both angles and that of the threshold hold no link; if even the far ends of
    both are nearer than the threshold, all their members are linked. Only middles meet here, dealt to blocks.
    """
    group = F.xxhash64("component") if within else F.col("space")
    keyed = balls.select("ball", "component", "center", "angle", group.alias("group"))
    counts = keyed.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = keyed.join(counts, "group").withColumn("own", F.pmod(F.xxhash64("ball"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "ball", "component", "center", "angle", "own",
        F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("block"),
        (F.col("own") == F.col("other")).alias("same"),
    )
    reach = float(np.arccos(threshold))

    def close(block: pa.Table) -> Iterator[pa.RecordBatch]:
        names = block.column("ball").to_numpy()
        centers = np.frombuffer(b"".join(block.column("center").to_pylist()), np.float64).reshape(len(names), -1)
        angles, side = block.column("angle").to_numpy(), block.column("own").to_numpy()
        inside = block.column("same")[0].as_py()
        kind = np.unique(np.array([c.hex() for c in block.column("component").to_pylist()]), return_inverse=True)[1]
        for start in range(0, len(names), BLOCK):
            part = slice(start, start + BLOCK)
            apart = np.arccos(np.clip(centers[part] @ centers.T, -1, 1))
            apart[names[part, None] == names[None, :]] = 0
            wide = angles[part, None] + angles[None, :]
            near = apart <= wide + reach + 1e-6
            near &= (names[part, None] <= names[None, :]) if within else (names[part, None] < names[None, :])
            near &= (kind[part, None] == kind[None, :]) == within
            if not inside:
                near &= side[part, None] != side[None, :]
            i, j = np.nonzero(near)
            every = (apart + wide <= reach - 1e-6)[i, j]
            arrays = [pa.array(names[start + i]), pa.array(names[j]), pa.array(every)]
            yield pa.RecordBatch.from_arrays(arrays, names=["x", "y", "every"])

    return map_blocks(dealt, "block", close, "x long, y long, every boolean").withColumn("pair", F.xxhash64("x", "y"))


def _meeting(pairs: DataFrame, own: DataFrame, *columns: str) -> DataFrame:
    """The members of both balls of each pair, by ``pair``."""
    ends = pairs.select("pair", F.col("x").alias("_ball")).union(pairs.where("x <> y").select("pair", F.col("y").alias("_ball")))
    return ends.join(own.select("ball", "node", "vec", *columns), F.col("_ball") == F.col("ball")).drop("_ball")


def crossing_links(members: DataFrame, tables: Scratch, threshold: float, name: str) -> DataFrame:
    """Links that join the members' components, exactly; one for every two balls that have any."""
    own, balls = balls_of(members.withColumn("copies", F.lit(1).cast("long")), tables, name)
    pairs = tables.write(ball_pairs(balls, threshold, within=False), f"{name}-pairs")

    def link(block: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes = block.column("node").to_pylist()
        rows = unit_rows(block.column("vec").to_pylist())
        first = block.column("ball").to_numpy() == block.column("ball")[0].as_py()
        a, b = np.flatnonzero(first), np.flatnonzero(~first)
        near = rows[a] @ rows[b].T
        i, j = np.unravel_index(near.argmax(), near.shape)
        if near[i, j] >= threshold:
            arrays = [pa.array([nodes[a[i]]], pa.binary()), pa.array([nodes[b[j]]], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

    return tables.write(map_blocks(_meeting(pairs, own), "pair", link, "a binary, b binary"), f"{name}-links")


def count_links(members: DataFrame, tables: Scratch, threshold: float) -> DataFrame:
    """``node`` and ``n``: how many vectors of the node's component, copies counted, are at the threshold.

    Balls that are linked as a whole are counted without comparing their members, so a dense group costs a number for each two
    balls; only balls at the threshold's border meet.
    """
    own, balls = balls_of(members, tables, "counts")
    pairs = tables.write(ball_pairs(balls, threshold, within=True), "count-pairs")
    sizes = balls.select(F.col("ball").alias("_other"), "copies")
    linked = pairs.where("every")
    sides = linked.select(F.col("x").alias("_at"), F.col("y").alias("_with")).union(linked.where("x <> y").select("y", "x"))
    whole = sides.join(sizes, F.col("_with") == F.col("_other")).groupBy("_at").agg(F.sum("copies").alias("_sum"), F.max(F.col("_at") == F.col("_with")).alias("_self"))
    # A ball that is linked as a whole holds the node itself too.
    summed = own.join(whole, F.col("ball") == F.col("_at")).select("node", (F.col("_sum") - F.when(F.col("_self"), F.col("copies")).otherwise(0)).alias("n"))

    def count(block: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes = block.column("node").to_pylist()
        rows = unit_rows(block.column("vec").to_pylist())
        copies = block.column("copies").to_numpy().astype(np.int64)
        side = block.column("ball").to_numpy()
        alone = (side == side[0]).all()
        counts = np.zeros(len(nodes), np.int64)
        for start in range(0, len(nodes), BLOCK):
            part = slice(start, start + BLOCK)
            near = rows[part] @ rows.T >= threshold
            near[np.arange(near.shape[0]), np.arange(start, start + near.shape[0])] = False
            if not alone:
                near &= side[part, None] != side[None, :]
            counts[part] = near @ copies
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(counts)], names=["node", "n"])

    met = _meeting(pairs.where(~F.col("every")), own, "copies")
    counted = map_blocks(met, "pair", count, "node binary, n long").unionByName(summed)
    return counted.groupBy("node").agg(F.sum("n").alias("n"))


def audit(nodes: DataFrame, threshold: float, seed: int) -> DataFrame:
    """All links of about ``AUDITED`` nodes, by comparing them with every node."""
    total = nodes.count()
    draw = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, AUDITED / max(1, total)) * (1 << 30))
    asked = nodes.where(draw).select("node", "space", "vec").collect()
    queries: dict[int, tuple[list[bytes], np.ndarray]] = {}
    for space in {r["space"] for r in asked}:
        own = [r for r in asked if r["space"] == space]
        queries[space] = [bytes(r["node"]) for r in own], unit_rows([bytes(r["vec"]) for r in own])
    shared = nodes.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            names, spaces, vecs = (batch.column(i).to_pylist() for i in range(3))
            by_space: dict[int, list[int]] = {}
            for i, space in enumerate(spaces):
                by_space.setdefault(space, []).append(i)
            for space, at in by_space.items():
                if space not in known:
                    continue
                own, rows = known[space]
                near = unit_rows([vecs[i] for i in at]) @ rows.T
                found = [(own[q], names[at[i]], near[i, q]) for i, q in zip(*np.nonzero(near >= threshold))]
                found = [f for f in found if f[0] != f[1]]
                if found:
                    a, b, c = zip(*found)
                    arrays = [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "cosine"])

    return nodes.select("node", "space", "vec").mapInArrow(run, PAIRS)


def near_duplicates(
    vectors: DataFrame,
    tables: Scratch,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` of every row."""
    source = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    usable = source.mapInArrow(_vectors, "vec_id long, label string, vec binary")
    digest = F.unhex(F.md5(F.concat("vec", F.lit("\0"), F.col("label").cast("binary"))))
    usable = usable.withColumn("node", digest)
    rows = tables.write(usable.select("vec_id", "node", "label", "vec"), "vectors")
    space = F.xxhash64("label", F.octet_length("vec"))
    nodes = rows.groupBy("node").agg(
        F.first("vec").alias("vec"),
        F.first(space).alias("space"),
        F.count(F.lit(1)).alias("copies"),
        F.min("vec_id").alias("smallest"),
    )
    nodes = tables.write(nodes, "nodes")
    links = lists = None
    for attempt in range(TRIES):
        pathed = tables.write(with_paths(nodes, TREES, attempt * TREES), f"paths-{attempt}")
        pairs = tree_pairs(pathed, 0, threshold)
        for tree in range(1, TREES):
            pairs = pairs.unionByName(tree_pairs(pathed, tree, threshold))
        pairs = pairs.withColumn("old", F.lit(False))
        if lists is not None:
            pairs = pairs.unionByName(lists.drop("rank").withColumn("old", F.lit(True)))
        lists = tables.write(best_lists(pairs), f"lists-{attempt}-0")
        for round_ in range(1, ROUNDS + 1):
            lists = tables.write(descend(lists.drop("old"), nodes, round_, threshold), f"lists-{attempt}-{round_}")
            places = lists.where(F.col("rank") <= NEIGHBOURS).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("old")).alias("new")).first()
            if places["new"] <= FEW * places["n"]:
                break
        lists = lists.drop("old")
        found = lists.where(F.col("cosine") >= threshold).select("a", "b")
        links = found if links is None else links.unionByName(found)
        component = components(links, tables, f"components-{attempt}")
        full = full_lists(lists.withColumn("link", F.col("cosine") >= threshold))
        full = nodes.select("node", "space", "vec").join(full, "node").join(component, "node")
        crossing = crossing_links(full, tables, threshold, f"crossing-{attempt}")
        if crossing.take(1):
            links = links.unionByName(crossing)
            component = components(links, tables, f"crossed-{attempt}")
        seen = tables.write(audit(nodes, threshold, attempt), f"audit-{attempt}")
        side = component.select("node", "component")
        checked = seen.join(side.toDF("a", "ca"), "a", "left").join(side.toDF("b", "cb"), "b", "left")
        share = checked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ca") == F.col("cb")).alias("hit")).first()
        links = tables.write(links.unionByName(seen.select("a", "b")), f"links-{attempt}")
        if share["hit"] >= RECALL * share["n"]:
            break
    component = components(links, tables, "components")
    if share["hit"] < RECALL * share["n"]:  # every component, of one node too, is compared with all others
        whole = nodes.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        missed = crossing_links(whole.select("node", "space", "vec", "component"), tables, threshold, "exact")
        component = components(links.unionByName(missed), tables, "exact-components")
    members = nodes.join(component, "node").select("node", "space", "vec", "copies", "component")
    counts = tables.write(count_links(members, tables, threshold), "counts")
    named = nodes.select("node", "smallest", "copies").join(component, "node", "left").join(counts, "node", "left")
    named = tables.write(named.withColumn("component", F.coalesce("component", "node")), "named")
    names = named.groupBy(F.col("component").alias("_component")).agg(F.min("smallest").alias("component_id"))
    crowds = skew.heavy_keys(named, "component", HOT_ROWS)
    by_node = skew.lookup(named, names, "component", "_component", ["node"], crowds, "inner").select(
        F.col("node").alias("_node"), "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    # Copies of one vector may be a large share of all rows.
    crowds = skew.heavy_keys(rows, "node", HOT_ROWS)
    linked = skew.lookup(rows.select("vec_id", "node"), by_node, "node", "_node", ["vec_id"], crowds, "inner")
    linked = linked.select("vec_id", "n_links", "component_id")
    return linked.unionByName(_unusable(source))


def _unusable(source: DataFrame) -> DataFrame:
    """The rows that link with nothing."""
    v = F.col("v")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(v, lambda x: x == 0)
    alone = F.col("label").isNull() | v.isNull() | (F.size(v) == 0) | odd | zero
    return source.where(F.coalesce(alone, F.lit(True))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
