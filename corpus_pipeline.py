"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

Defined cases, for every stage: columns besides doc_id, text and source may have any name, also one
that an operator uses itself, and come back as they were; an empty table gives an empty table with
the same columns. Null and empty texts, rows without an id, ties and repeated rows are told with
each stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, mixing, ngram_join, quality, sharding
from sparkloom.llm.common import Scratch, few, saved, table
from sparkloom.llm.substring_dedup import FIRST_ID

#: Near duplicates of the pipeline: five words, similarity of 0.8 or more.
GRAM, NUM, DEN = 5, 80, 100


def _apart(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with names of their own for the columns that no stage reads, and what selects them under their old names."""
    names = {c: c if c in ("doc_id", "text", "source") else f"in_{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(n).alias(c) for c, n in names.items()]


def _same(docs: DataFrame):
    """Whether a row of ``docs`` has the id and the text's hash of a row (g_id, g_tag)."""
    return F.coalesce(docs["doc_id"].cast("bigint"), F.lit(FIRST_ID)).eqNullSafe(F.col("g_id")) & (F.xxhash64(docs["text"]) == F.col("g_tag"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text are not in ``gone`` (g_id, g_tag)."""
    return docs.join(F.broadcast(gone) if few(gone) else gone, _same(docs), "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored like any other; repeated rows go or stay together."""
    own, back = _apart(docs)
    model = quality.learn(own, table(spark, sf_dir, "labels"))
    return quality.score(own, model, tuple(own.columns), name="_quality").where(F.col("_quality") >= quality.THRESHOLD).select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays, once.

    Null and wordless texts are near to nothing and stay. Rows without an id come after all others; of equal ids the
    least hash of the text stays. Of rows that repeat id and text one stays: the least by its other columns, as JSON.
    """
    own, back = _apart(docs)
    rows = ngram_join.near_classes(own, GRAM, NUM, DEN, names=True)
    rows = saved(rows.groupBy("id", "tag").agg(F.count("*").alias("copies"), F.first("stays").alias("stays")).where("not stays or copies > 1"), "near")
    left = _without(own, rows.select(F.col("id").alias("g_id"), F.col("tag").alias("g_tag")))
    twice = rows.where("stays").select(F.col("id").alias("g_id"), F.col("tag").alias("g_tag"))
    if not twice.isEmpty():
        row = F.struct(*own.columns)
        once = own.join(twice, _same(own), "left_semi").groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
        left = left.unionByName(once)
    return left.select(*back)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Null and wordless texts stay; repeated rows go or stay together."""
    own, back = _apart(docs)
    found = decontaminate.hits(own, table(spark, sf_dir, "benchmark"))
    gone = saved(found.where(F.size("items") > 0).select(F.coalesce(F.col("id").cast("bigint"), F.lit(FIRST_ID)).alias("g_id"), F.col("row_key").alias("g_tag")), "leaks")
    return _without(own, gone).select(*back)


def repeat_by_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; those it does not take go.

    Null and wordless texts have no size and come as often as their source's whole repetitions and their place in
    its order tell; a null source is a source of its own; repeated rows are documents of their own.
    """
    own, back = _apart(docs)
    rows = mixing.mix(own, keep=own.columns)
    return rows.select(*own.columns, F.explode(F.array_repeat(F.lit(0), F.col("repeats").cast("int")))).select(*back)


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with size, text_crc32, shard and slot. Columns of these names in ``docs`` come back with ``_in`` behind them.

    Null texts have 8 bytes and no checksum; repeated rows are rows of their own.
    """
    own, back = _apart(docs)
    measures = ("size", "text_crc32", "shard", "slot")
    rows = sharding.shard(own, keep=own.columns)
    return rows.select(*[c.alias(_free(n, docs.columns)) if n in measures else c for c, n in zip(back, docs.columns, strict=True)], *measures)


def _free(name: str, taken: Sequence[str]) -> str:
    name += "_in"
    return _free(name, taken) if name in taken else name


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", repeat_by_mix),
    ("sharding", deal_to_shards),
]

#: The classifier's votes cannot be written in SQL; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; what a stage has saved is deleted once the next one's rows are written."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for name, stage in STAGES:
            docs = saved(stage(spark, docs, sf_dir), name)
            scratch.clear()
    return docs
