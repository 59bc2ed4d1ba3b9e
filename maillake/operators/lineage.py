"""Cutting lineage of iterative jobs with written tables, so a lost executor costs no earlier round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCAL_FOLDER = "maillake.local.folder"
# While it is on, Spark removes the shuffle files of a query when the query ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = spark.conf.get(LOCAL_FOLDER, None) or tempfile.mkdtemp(prefix="maillake-")
    spark.conf.set(LOCAL_FOLDER, folder)
    return folder


class Scratch:
    """Tables of one job under the shared folder."""

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"
        self.written: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write and read back: the result has no lineage and known statistics.

        What was shuffled for it is not read again, so a job of many rounds holds the shuffle files of one query at a time.
        """
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEANUP, before)
        self.written.append(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
        self.written = [name for name in self.written if name not in names]


class Rounds:
    """The table of an iterative job: each round adds its rows, apart by whether they are ``done``.

    Both are partition columns, so the settled rows of all rounds and the open rows of the last one are
    one scan that opens no other files.
    """

    def __init__(self, scratch: Scratch, name: str) -> None:
        self.scratch = scratch
        self.folder = scratch.path(name)
        self.last = -1
        self.schema = T.StructType()

    def add(self, df: DataFrame) -> None:
        self.last += 1
        self.schema = T.StructType(df.schema.fields + [T.StructField("round", T.IntegerType())])
        df.write.partitionBy("done").parquet(f"{self.folder}/round={self.last}")

    def _read(self) -> DataFrame:
        return self.scratch.spark.read.schema(self.schema).parquet(self.folder)

    def open(self) -> DataFrame:
        """Rows still open after the last round."""
        return self._read().where(~F.col("done") & (F.col("round") == self.last)).drop("round")

    def state(self) -> DataFrame:
        """Settled rows of every round and the open rows of the last."""
        return self._read().where(F.col("done") | (F.col("round") == self.last)).drop("round")
