"""Operator 6: mixing sources to target weights by capped water-filling. DataFrame functions only.

Every source asks for its weight's part of the total; a source is clamped at ``epochs`` times
its size, and what it leaves is shared out again by weight until no source is above its cap.
The level is found in rounds of sums over the sources.
A document is then repeated floor(target / size of source) times, and the rest of the target
is met by one more repetition of the first documents in a seeded order (by MD5 of seed and
doc_id): those whose middle lies within the rest, so a source misses its target by at most
half of one document.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows
with the same doc_id are documents of their own; sources of size 0 have the target 0; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.merge import numbered
from .common import BROADCAST_ROWS, few, saved, table, word_count

WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, "mix-1"
#: Hex digits of the seeded order that name a document's bucket: only one bucket of a source is ranked row by row.
BUCKET = 3


def targets(sources: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.

    Rounds of water-filling, each one sum over the sources: what is clamped at its cap leaves the level, and the rest is
    shared out again by weight until none is above its cap. The level alone reaches the driver; sources are numbered
    by ranges, so that any number of them will do.
    """
    nth = (F.col("_nth") - 1) % len(weights) + 1
    rows = numbered(sources, [F.col("source").asc_nulls_last()], "_nth").withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), nth.cast("int"))).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    rows = saved(rows.drop("_nth"), "mix-sources")
    level, before = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("cap") / F.col("w") <= F.lit(level)
        r = rows.agg(F.count_if(full).alias("n"), (F.sum("source_size") - F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0))).cast("double").alias("rest"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if r["n"] == before or not r["w"]:
            level = None if not r["w"] else level
            break
        level, before = r["rest"] / r["w"], r["n"]
    cap = F.col("cap").cast("double")
    return rows.select("source", "source_size", (cap if level is None else F.least(cap, F.col("w") * F.lit(level))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, size: Column | None = None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Every document with size, source_size, target, repeats and taken = repeats x size.

    ``keep`` names the columns to carry along besides the measures.
    """
    size = word_count(F.col("text")) if size is None else size
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    rows = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.col("doc_id").alias("m_id"), F.col("source"), size.alias("size"), key.alias("key"))
    rows = rows.withColumn("bucket", F.substring("key", 1, BUCKET))
    if "text" not in keep:
        rows = saved(rows, "mix")
    sums = saved(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")), "mix-sums")
    plan = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(rate)).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    ends = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
    cuts = sums.withColumn("end", ends).select(F.col("source").alias("s"), "bucket", "end", (F.col("end") - F.col("n")).alias("start"))
    # the bucket in which the rest of the target ends; documents of earlier ones are all taken once more
    cuts = cuts.join(plan.select(F.col("source").alias("s2"), "rest"), F.col("s").eqNullSafe(F.col("s2"))).where("end > rest").groupBy("s").agg(F.min(F.struct("bucket", "start")).alias("cut"))
    plan = saved(plan.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("p_source"), "source_size", "target", "whole", "rest", "cut"), "mix-plan")
    rows = rows.join(F.broadcast(plan) if few(plan, BROADCAST_ROWS) else plan, F.col("source").eqNullSafe(F.col("p_source")))
    edge = F.coalesce(F.col("bucket") == F.col("cut.bucket"), F.lit(False))
    before = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("key", "m_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    last = rows.where(edge).withColumn("mid", F.col("cut.start") + F.coalesce(before, F.lit(0)) + F.col("size") / 2).withColumn("more", F.when(F.col("mid") <= F.col("rest"), 1).otherwise(0)).drop("mid")
    rows = rows.where(~edge).withColumn("more", F.when(F.col("cut").isNull() | (F.col("bucket") < F.col("cut.bucket")), F.when(F.col("rest") > 0, 1).otherwise(0)).otherwise(0)).unionByName(last)
    repeats = (F.col("whole") + F.col("more")).cast("long")
    return rows.select(*[F.col(f"k_{c}").alias(c) for c in keep], "size", F.col("source_size"), "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("repeats")


SQL = f"""
WITH rows AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size, md5(concat_ws(':', '{SEED}', doc_id::VARCHAR)) AS key FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM rows GROUP BY source
), caps AS (
  SELECT source, source_size, {EPOCHS} * source_size AS cap, [{", ".join(map(str, WEIGHTS))}][nth % {len(WEIGHTS)} + 1] AS w FROM sums
), levels AS (
  SELECT *, cap / w AS ratio, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM caps
), plan AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, w * (SELECT level FROM levels WHERE ratio > level ORDER BY ratio, level LIMIT 1)), cap::DOUBLE) AS target FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM plan
), mids AS (
  SELECT r.*, p.source_size, p.target, p.whole, greatest(p.target - p.whole * p.source_size, 0.0) AS rest,
    coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS mid
  FROM rows r JOIN rates p ON r.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, ((whole + CASE WHEN mid <= rest AND rest > 0 THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM mids
"""
