"""Sinks: staged overwrite, append, chunks and single-file results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.merge import numbered


def clean(df: DataFrame) -> DataFrame:
    """Text cells without carriage returns or line breaks, as one-line CSV rows need."""
    return df.select(*[F.regexp_replace(c, r"[\r\n]+", " ").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def append_csv(df: DataFrame, path: str) -> None:
    clean(df).write.mode("append").option("header", True).option("escape", '"').csv(path)


def overwrite_json(df: DataFrame, path: str) -> None:
    """Written beside the target first, then the old is moved away, the new moved in and the old deleted. A failure leaves the old or the new whole, under its own name or beside it with ``.old``."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, staged, old = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".staged", ".old"))
    df.write.mode("overwrite").json(staged.toString())
    fs = target.getFileSystem(conf)
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"cannot move {path} away")
    if not fs.rename(staged, target):
        fs.rename(old, target)
        raise OSError(f"cannot move the new {path} in")
    fs.delete(old, True)


def results(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Small aggregate tables as one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).format(kind).save(path)


def chunked(df: DataFrame, path: str, order: str, size: int = 30) -> None:
    """Rows in order, ``size`` to a chunk, a folder a chunk."""
    rows = numbered(df, [order], "_number")
    rows.withColumn("chunk", F.floor((F.col("_number") - 1) / size).cast("int")).drop("_number").write.mode("overwrite").partitionBy("chunk").json(path)


def blocks(df: DataFrame, path: str, number: str = "number", body: str = "body") -> None:
    """Markdown blocks in order of number, as text."""
    df.orderBy(number).select(F.col(body).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def upsert_blocks(old: DataFrame, new: DataFrame, key: str = "pid") -> DataFrame:
    """Blocks of a document with those of ``new`` in place of or beside the old ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def stub_headers(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Blocks (pid, title, body) whose paper is a duplicate (``pairs``: dup, original) get a stub's title and a notice before their body; stubs stay as they are."""
    out = blocks.join(pairs, F.col("pid") == F.col("dup"), "left")
    own = F.col("original").isNotNull() & ~F.col("title").startswith("[STUB")
    title = F.concat(F.lit("[STUB-DEDUP-OF-"), "original", F.lit("] "), "title")
    notice = F.concat(F.lit("> [STUB-DEDUP "), "dup", F.lit(" = "), "original", F.lit("]\n\n"), "body")
    return out.select("pid", F.when(own, title).otherwise(F.col("title")).alias("title"), F.when(own, notice).otherwise(F.col("body")).alias("body"))


def without_leaves(leaves: DataFrame, pairs: DataFrame) -> DataFrame:
    """Leaves of a taxonomy (pid, ...) without those of duplicate papers."""
    return leaves.join(pairs.select(F.col("dup").alias("pid")), "pid", "left_anti")


def replace_between(document: Column, start: str, end: str, text: Column) -> Column:
    """The document with ``text`` between its two markers; without them it stays as it is."""
    head, tail = F.substring_index(document, start, 1), F.substring_index(document, end, -1)
    return F.when(document.contains(start) & document.contains(end), F.concat(head, F.lit(start + "\n"), text, F.lit("\n" + end), tail)).otherwise(document)


def upsert_section(document: Column, heading: str, until: str, text: Column) -> Column:
    """The document with ``text`` from the line that begins with ``heading`` up to the one that matches ``until``, or at its end where there is none."""
    own = rf"(?ms)^##\s*{heading}\b.*?(?=^##\s*(?:{until})\b|\z)"
    return F.when(document.rlike(own), F.regexp_replace(document, F.lit(own), F.concat(F.regexp_replace(text, r"([\\$])", r"\\$1"), F.lit("\n\n")))).otherwise(F.concat(F.rtrim(document), F.lit("\n\n# Appendix\n\n"), text, F.lit("\n")))
