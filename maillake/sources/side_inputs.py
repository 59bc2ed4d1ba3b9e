"""Small inputs beside the messages."""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger("maillake")
WARNED = 5


def crm_from_json(texts: DataFrame, column: str = "value", file: str | None = None) -> DataFrame:
    """JSON objects ``address -> customer id`` as rows ``email, customer_id``.

    Values that are not strings and texts that are not objects are left out; of a repeated address the
    last one counts, in the order of ``file`` names and within a text.
    """
    name = F.col(file) if file else F.lit("")
    parsed = texts.select(name.alias("file"), F.map_entries(F.from_json(column, "map<string,variant>")).alias("entries"))
    pairs = parsed.select("file", F.posexplode("entries").alias("pos", "entry"))
    value = F.col("entry.value")
    strings = pairs.where((F.schema_of_variant(value) == "STRING") & F.col("entry.key").isNotNull())
    named = strings.select(
        F.struct("file", "pos").alias("pos"), F.col("entry.key").alias("email"), F.variant_get(value, "$", "string").alias("customer_id")
    )
    return named.groupBy("email").agg(F.max_by("customer_id", "pos").alias("customer_id"))


def _is_object(column: str) -> Column:
    return F.from_json(column, "map<string,variant>").isNotNull() & F.col(column).rlike(r"\A\s*\{")


def read_crm_map(spark: SparkSession, path: str | None, form: str = "json") -> DataFrame:
    """CRM map as rows ``email, customer_id``.

    ``json`` reads files holding one object each (a folder of them is read in parallel); ``parquet`` and
    ``ndjson`` read a two-column table and are meant for maps too large for one object. A missing or
    unreadable path, and a file that holds no object, give an empty map and a warning.
    """
    nothing = spark.createDataFrame([], "email string, customer_id string")
    if not path or not path.strip():
        return nothing
    try:
        if form == "json":
            texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
            # Only names of files that hold something else than an object come to the driver, and only a few.
            odd = texts.where((F.trim("value") != "") & ~F.coalesce(_is_object("value"), F.lit(False)))
            for row in odd.select("file").take(WARNED):
                LOG.warning("no CRM map in %s: not a JSON object", row["file"])
            return crm_from_json(texts, file="file")
        if form == "ndjson":
            return spark.read.schema("email string, customer_id string").json(path)
        if form == "parquet":
            return spark.read.parquet(path).select("email", "customer_id")
    except PySparkException as problem:
        LOG.warning("no CRM map from %s: %s", path, problem)
        return nothing
    raise ValueError(f"unknown form {form!r}")
