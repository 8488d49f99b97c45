"""Paged search results as a source, and counts looked up in a table. Nothing here reaches a network: pages are files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def search(spark: SparkSession, path: str, schema: str, page: str = "page", lines: bool = False) -> DataFrame:
    """Records of the pages before the first that is missing or empty: paging stops there, whatever comes later.

    Pages are JSON lists, a folder (``page=n``) a page, or with ``lines`` objects of ``page`` and ``records``, one a line: a few
    files hold any number of pages.
    """
    records = f"array<struct<{schema_of(schema)}>>"
    if lines:
        raw = spark.read.schema(f"{page} int, records {records}").json(path)
    else:
        raw = spark.read.option("wholetext", True).text(path).select(F.col(page).cast("int").alias(page), F.from_json("value", records).alias("records"))
    pages = raw.where((F.size("records") > 0) & (F.col(page) >= 0))
    # the first page that is missing follows the least that has no next, or is 0: an equi-join, no pairs of pages
    own = pages.select(F.col(page).alias("_p"))
    ends = own.unionByName(spark.range(1).select(F.lit(-1).alias("_p"))).join(own.select((F.col("_p") - 1).alias("_p")), "_p", "left_anti")
    reached = pages.join(F.broadcast(ends.agg(F.min("_p").alias("_last"))), F.col(page) <= F.col("_last"))
    return reached.select(page, F.explode("records").alias("r")).select(page, "r.*")


def schema_of(schema: str) -> str:
    """``a bigint, b string`` as the fields of a struct."""
    return ", ".join(": ".join(part.split(None, 1)) for part in schema.split(", "))


def with_counts(records: DataFrame, counts: DataFrame, key: str, count: str) -> DataFrame:
    """Records with a count from a table, 0 where it has none."""
    return records.join(counts.select(key, count), key, "left").withColumn(count, F.coalesce(count, F.lit(0)))
