"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship  # noqa: F401  one package file an application

_tables: list[str] = []

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: What separates words: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: A set of rows is broadcast only when it is counted and has no more rows than this (a row has under 1 kB).
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, one is made on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        found = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, and a lost executor takes nothing along.

    ``by`` names a column of few values to lay the files out by. The table is deleted when the
    application ends, however it ends, or by ``Scratch``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _tables.append(path)
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        system, where = _folder(spark, path)
        system.deleteOnExit(where)  # only what exists can be marked
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str) -> tuple:
    """(file system, path) in the JVM."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


class Scratch:
    """Deletes, at each ``clear`` and at the end, the tables saved within it, but for the last."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.since = spark, len(_tables)

    def clear(self, keep: int = 1) -> None:
        gone = _tables[self.since : len(_tables) - keep]
        del _tables[self.since : len(_tables) - keep]
        for path in gone:
            system, where = _folder(self.spark, path)
            system.delete(where, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind, *_) -> None:
        self.clear(0 if kind else 1)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def word_count(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no more than one row beyond them."""
    return df.limit(most + 1).count() <= most


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are saved: it does so when the driver's JVM has collected them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
