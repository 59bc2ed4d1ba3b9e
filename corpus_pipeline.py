"""Documents to a training corpus in five stages; each is written as Parquet and read again by the next.

``run(spark, sf_dir)`` applies them to the table ``documents``. Every stage takes all rows that its predecessor kept:

1. ``language``: documents go whose predicted language is none of ``LANGUAGES`` (by default all that the labels name), or that
   have no language (no text, no letter);
2. ``near_duplicates``: one document of each group of near-duplicates stays, the one with the smallest key;
3. ``decontaminate``: documents that hold a benchmark item go;
4. ``mix``: documents are left out or repeated so that sources come near their weights;
5. ``shard``: every row gets a shard; shards are near equal in bytes.

All but the last return the columns of their input, whatever these are named besides ``doc_id``, ``text``, ``lang`` and
``source``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maillake.llm import decontaminate as decontamination
from maillake.llm import language as languages
from maillake.llm import mixing, near_dup, queries, sharding
from maillake.llm.registry import query
from maillake.llm.store import bound_batches, scratch, table

SHARDS = 24
LANGUAGES: tuple[str, ...] | None = None  # languages of the corpus; None: all that are learnt


def _nested(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns beside the whole row, so that columns of operators replace none of the input."""
    return docs.select(*needed, F.struct(*docs.columns).alias("_row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    model = languages.train(docs)
    if not model.languages:  # nothing to learn from: only texts without a letter are surely in no language
        return docs.where(F.col("text").rlike(r"\p{L}"))
    wanted = model.languages if LANGUAGES is None else [name for name in model.languages if name in LANGUAGES]
    told = languages.identify(_nested(docs, "text"), model)
    return told.where(F.col("lang_pred").isin(wanted)).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return near_dup.deduplicate(docs, scratch(spark, "pipeline-near-dup"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    benchmark = table(spark, sf_dir, "benchmark")
    tables = scratch(spark, "pipeline-decontaminate")
    found = decontamination.find_items(_nested(docs, "text"), benchmark, tables)
    return found.where(F.size("item_ids") == 0).select("_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, scratch(spark, "pipeline-mix"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``virtual_slot`` and ``shard``."""
    return queries.with_shards(spark, docs, SHARDS)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

# Near-duplicates and the retrieval of passages cannot be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tables.write(stage(spark, docs, sf_dir), name)
    return docs


query("pipeline", ORACLE_SQL)(run)
