"""Mixing sources to target weights, with DataFrame functions only.

``measure`` counts words, ``plan`` derives from the words per source how often each document is taken, and
``emit`` repeats the documents. A document is taken floor(rate) times, and once more if a number hashed from a
seed and its key falls below the fraction of the rate. Few long documents would make a source miss its target by
chance, so each source uses the one of ``SEEDS`` seeds with which its words come nearest; the words under every seed
are summed in one aggregation.

Defined results: a null text has size 0; a null source is a source of its own and comes last; rows with the
same key get the same number, so repeated rows are taken alike; an empty table gives an empty plan; sources
without any word have target 0 and are not taken. Columns of the input are kept; the columns added by
``measure`` and ``plan`` replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.lineage import Scratch
from ..operators.skew import lookup_measured
from .store import quoted, uniform

WEIGHTS = (5, 2, 1)
SEEDS = 16
MOST = 3  # a target stops at so many times its source's size
WORD = r"[^\x20\x09-\x0D]+"
PLANNED = ("source_size", "target", "rate", "copies")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with ``size``: their number of words."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def targets(
    measured: DataFrame, source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``weight``, ``target``.

    All words are shared by weight; what a source may not take (``most`` times its size) is shared again by
    the others. In the order of ``limit / weight`` the sources that reach their limit come first, and a
    source reaches it if it is not above its share of what the ones before it leave. So running sums find
    them all, without repeating the sharing. The windows see one narrow row per source, never documents.
    """
    sizes = measured.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    limit = F.col("source_size").cast("double") * most
    weighed = sizes.withColumn("weight", weight).withColumn("_limit", limit)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_ratio = W.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(every).cast("double")
    left = total - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    shared = weighed.withColumn("_left", left).withColumn("_weight_left", weight_left)
    full = F.col("_limit") * F.col("_weight_left") <= F.col("weight") * F.col("_left")
    # The first source below its limit (with the most weight left) knows what all of them share.
    first = F.max(F.when(~F.col("_full"), F.struct("_weight_left", "_left"))).over(every)
    shared = shared.withColumn("_full", full).withColumn("_first", first)
    share = F.col("weight") * F.col("_first._left") / F.col("_first._weight_left")
    target = F.when(F.col("_full"), F.col("_limit")).otherwise(share)
    return shared.select("source", "source_size", "weight", target.alias("target"))


def _key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def source_plan(
    sized: DataFrame,
    tables: Scratch,
    key: str = "doc_id",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    seed: int = 0,
) -> DataFrame:
    """One stored row per source: ``_source_key``, ``source_size``, ``target``, ``rate`` and ``_seed``.

    ``sized`` is a stored narrow table with ``size``; it is read for the sums and for the words under each seed.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = targets(sized, source, weights, most).select(
        _key(F.col("source")).alias("_source_key"), "source_size", "target", rate.alias("rate")
    )
    rates = tables.write(rates, "rates")
    keyed = sized.select(_key(F.col(source)).alias("_key"), F.col(key).cast("string").alias("_id"), "size")
    rated = lookup_measured(keyed, rates, "_key", "_source_key", ["_id", "size"])
    every = F.explode(F.sequence(F.lit(seed), F.lit(seed + SEEDS - 1)))
    drawn = rated.withColumn("_seed", every)
    words = F.sum(F.col("size") * _copies(uniform(F.col("_seed").cast("string"), "_id")))
    summed = drawn.groupBy("_key", "_seed").agg(words.alias("_words"), F.first("target").alias("_target"))
    miss = F.struct(F.abs(F.col("_words") - F.col("_target")), F.col("_seed"))
    best = summed.groupBy(F.col("_key").alias("_source_key")).agg(F.min_by("_seed", miss).alias("_seed"))
    return tables.write(rates.join(best, "_source_key"), "sources")


def _copies(draw: Column) -> Column:
    whole = F.floor("rate")
    return whole + (draw < F.col("rate") - whole).cast("long")


def apply_plan(docs: DataFrame, sources: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Documents with ``source_size``, ``target``, ``rate`` and ``copies``: how often each is taken.

    The sources are broadcast if they are measured to be small, else joined by salted source, so a source with a
    third of the rows is no hot key.
    """
    # The row travels in one struct, so no column of the input meets one of the plan.
    kept = [c for c in docs.columns if c.lower() not in PLANNED]
    row = F.struct(*[docs[quoted(c)] for c in kept]).alias("_row")
    keyed = docs.select(docs[quoted(key)].cast("string").alias("_id"), _key(docs[quoted(source)]).alias("_key"), row)
    joined = lookup_measured(keyed, sources, "_key", "_source_key", ["_id"])
    copies = _copies(uniform(F.col("_seed").cast("string"), "_id"))
    return joined.withColumn("copies", copies).select("_row.*", *PLANNED)


def plan(measured: DataFrame, tables: Scratch, key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """Measured documents, a stored table, with the columns of ``apply_plan``."""
    return apply_plan(measured, source_plan(measured, tables, key, source, **options), key, source)


def emit(planned: DataFrame) -> DataFrame:
    """Each planned document as often as it is taken, numbered by ``copy`` from 1."""
    taken = planned.where(F.col("copies") > 0).drop("copy")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def mix(
    docs: DataFrame, tables: Scratch, key: str = "doc_id", text: str = "text", source: str = "source", **options
) -> DataFrame:
    """The mixed documents with the columns of the input. Their words are counted once, into a narrow table."""
    row = F.struct(*docs.columns).alias("row")
    sized = measure(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), F.col(text).alias("text")))
    sized = tables.write(sized.select("id", "source", "size"), "sizes")
    packed = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), row)
    planned = apply_plan(packed, source_plan(sized, tables, "id", "source", **options), "id", "source")
    return emit(planned).select("row.*")
