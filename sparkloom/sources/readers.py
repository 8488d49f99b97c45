"""Sources: every reader returns a DataFrame and reads through Spark, so any store that Spark knows will do."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of a study registry, in order.
REGISTRY = (
    "Paper_ID Category Modality Method_Architecture Task_Type Best_Metric Best_AUC Dataset Sample_N_Approx Validation_Type Key_Novelty "
    "Primary_Limitation Open_Problems Journal Architecture_Family XAI_Method Publication_Year ADNI_Dependent study_design_type task_substage "
    "population_specificity modality_subtype prediction_horizon_years primary_metric_type duplicate_of"
).split()


def registry(spark: SparkSession, path: str, learned: Sequence[str] = ()) -> DataFrame:
    """A registry CSV, all text: quoted line breaks, doubled quotes and a byte-order mark are understood; columns by name, missing ones null."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    wanted = [*REGISTRY, *[c for c in learned if c not in REGISTRY]]
    return df.select(*[F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string").alias(c) for c in wanted])


def last_by_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one id the last in ``order``."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_k = 1").drop("_k")


def ledger(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Records of a JSON ledger, either a list or an object that holds the list under ``key``: (pos, record as variant)."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", f"$.{key}", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    return whole.select(F.posexplode(listed).alias("pos", "record"))


def field(record: str, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(record, f"$.{name}", kind).alias(name)


def references(records: DataFrame, record_id: str, lists: Sequence[str], scalars: Sequence[str], name: str) -> DataFrame:
    """(ledger, record, field, pid) of every paper that records refer to, by array or by single value."""
    many = lambda c: F.transform(F.coalesce(F.try_variant_get("record", f"$.{c}", "array<string>"), F.array().cast("array<string>")), lambda p: F.struct(F.lit(c).alias("field"), p.alias("pid")))
    parts = [many(c) for c in lists]
    parts += [F.array(F.struct(F.lit(c).alias("field"), F.try_variant_get("record", f"$.{c}", "string").alias("pid"))) for c in scalars]
    return records.select(F.lit(name).alias("ledger"), F.try_variant_get("record", f"$.{record_id}", "string").alias("record"), F.explode(F.flatten(F.array(*parts))).alias("r")).select("ledger", "record", "r.field", "r.pid").where("pid is not null")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """(pid, title, body) of a Markdown document's ``## Paper n: title`` blocks."""
    parts = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)(?=^##\s+Paper\s)")).alias("body"))
    head = r"^##\s+Paper\s+(?:P-)?(\d+)\s*:?[ \t]*([^\n]*)"
    return parts.where(F.col("body").rlike(head)).select(F.concat(F.lit("P-"), F.regexp_extract("body", head, 1)).alias("pid"), F.trim(F.regexp_extract("body", head, 2)).alias("title"), "body")


def sections(df: DataFrame, body: str = "body", keys: Sequence[str] = ("pid",)) -> DataFrame:
    """(keys, pos, header, text) of the ``###`` sections."""
    parts = df.select(*keys, F.posexplode(F.split(body, r"(?m)^###\s*")).alias("pos", "part")).where("pos > 0")
    return parts.select(*keys, "pos", F.trim(F.substring_index("part", "\n", 1)).alias("header"), F.regexp_replace("part", r"^[^\n]*\n?\s*|\s+$", "").alias("text"))


def best_section(parts: DataFrame, words: Sequence[str], keys: Sequence[str] = ("pid",), least: int = 1) -> DataFrame:
    """Per key the section whose header shares most words with ``words``; the first on ties, none under ``least``."""
    score = F.size(F.array_intersect(F.split(F.lower(F.regexp_replace("header", r"[^\w\s]", " ")), r"\s+"), F.array(*map(F.lit, words))))
    return parts.withColumn("score", score).where(F.col("score") >= least).groupBy(*keys).agg(F.max_by(F.struct("header", "text"), F.struct("score", -F.col("pos"))).alias("s")).select(*keys, "s.header", "s.text")


def exact_section(parts: DataFrame, titles: Sequence[str], keys: Sequence[str] = ("pid",)) -> DataFrame:
    """Per key the text under the first of ``titles`` that exists."""
    rank = F.array_position(F.array(*[F.lit(t.lower()) for t in titles]), F.lower("header"))
    return parts.withColumn("r", rank).where("r > 0").groupBy(*keys).agg(F.min_by("text", F.struct("r", "pos")).alias("text"))


def zip_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The only CSV member of each archive, as text columns with the archive's ``path``; fails on any other number of members."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("path", *columns)])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, body in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(body)) as z:
                    members = [m for m in z.namelist() if m.lower().endswith(".csv")]
                    if len(members) != 1:
                        raise ValueError(f"{name} holds {len(members)} CSV members, not one")
                    with z.open(members[0]) as f:
                        for part in pd.read_csv(f, dtype=str, usecols=list(columns), chunksize=50_000):
                            part.insert(0, "path", name)
                            yield part[["path", *columns]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, schema)


def wide_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A projection of a wide CSV; columns that are not selected are not parsed."""
    return spark.read.option("header", True).csv(path).select(*columns)


def json_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON object a file, with the file's name without suffix as ``source_id``."""
    df = spark.read.schema(schema).option("multiLine", True).json(folder)
    return df.withColumn("source_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1))


def overridden(primary: DataFrame, better: DataFrame, key: str) -> DataFrame:
    """Primary records with every field of a better record in its place where that is known."""
    b = better.select(F.col(key), *[F.col(c).alias(f"_b_{c}") for c in better.columns if c != key])
    joined = primary.join(b, key, "full")
    return joined.select(key, *[F.coalesce(f"_b_{c}", c).alias(c) if c in better.columns else F.col(c) for c in primary.columns if c != key])


def html_leaves(df: DataFrame, html: str, tag: str, attribute: str, keys: Sequence[str]) -> DataFrame:
    """(keys, value, text) of elements without children that carry an attribute."""
    shape = rf'<{tag}[^>]*\b{attribute}="([^"]*)"[^>]*>([^<]*)</{tag}>'
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(shape), F.lit(1)).alias("value"), F.regexp_extract_all(html, F.lit(shape), F.lit(2)).alias("text"))
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.value", "p.text")


def event_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines that are neither blank nor comments."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")


def vocabulary(spark: SparkSession, path: str | None, key: str, fallback: Sequence[str]) -> DataFrame:
    """Words of a JSON config list, or the built-in ones where no file is given."""
    if path is None:
        return spark.createDataFrame([(w,) for w in fallback], "word string")
    return spark.read.option("multiLine", True).json(path).select(F.explode(key).alias("word"))


def refreshed(extracts: DataFrame, fresh: DataFrame, key: str, text: str, least: int = 200, noise: float = 0.04) -> DataFrame:
    """Cached extracts, replaced by fresh ones where they are short or corrupted."""
    from ..functions.text import corruption

    bad = F.col(text).isNull() | (F.length(text) < least) | (F.coalesce(corruption(F.col(text)), F.lit(1.0)) > noise)
    return extracts.join(fresh.select(key, F.col(text).alias("_fresh")), key, "full").withColumn(text, F.when(bad, F.coalesce("_fresh", text)).otherwise(F.col(text))).drop("_fresh")


def pending(meta: DataFrame, files: DataFrame, done: DataFrame, number: str, offset: int) -> DataFrame:
    """Rows with a file at number + offset that are not done yet."""
    return meta.join(files, F.col(number) + F.lit(offset) == F.col("file_idx")).join(done.select(number).distinct(), number, "left_anti")


def identity_signals(blocks_: DataFrame, registry_: DataFrame, mapped: DataFrame) -> DataFrame:
    """(pid, kind, value) of what may identify a paper: DOI fields, file identifiers, file names, titles."""
    from ..functions import text as t

    rows = blocks_.select("pid", "title", "body").join(registry_.select(F.col("Paper_ID").alias("pid"), F.col("doi").alias("doi_field")), "pid", "full").join(mapped.select("pid", "path", "map_doi"), "pid", "left")
    prose = F.regexp_extract_all("body", F.lit(r"(10\.\d{4,9}/[^\s\"'<>|,;)\]]+)"), F.lit(1))
    title = t.norm_title(t.plausible_title(F.col("title")))
    kinds = {"doi_field": t.norm_doi(F.col("doi_field")), "map_doi": t.norm_doi(F.col("map_doi")), "identifier": t.publisher_id(F.col("path")), "filename": t.basename(F.col("path")), "title": F.when(F.length(title) >= 25, title)}
    single = rows.select("pid", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.nullif(v, F.lit("")).alias("value")) for k, v in kinds.items()])).alias("s")).select("pid", "s.kind", "s.value")
    many = rows.select("pid", F.lit("doi_prose").alias("kind"), F.explode(F.transform(prose, t.norm_doi)).alias("value"))
    return single.unionByName(many).where("value is not null").distinct()
