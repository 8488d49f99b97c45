"""New registry rows as a stream: the same batch operators on each micro-batch, every id once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def new_rows(spark: SparkSession, folder: str, schema: str, kind: str = "json", time: str | None = None, delay: str = "1 day", key: str = "Paper_ID") -> DataFrame:
    """Rows of files as they arrive; with an event time, ids are taken once within the watermark."""
    rows = spark.readStream.schema(schema).format(kind).load(folder)
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]) if time else rows


def apply(rows: DataFrame, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "Paper_ID") -> StreamingQuery:
    """Run ``step`` on each micro-batch's new ids and append its result as Parquet under the batch's number, so that a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        step(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
