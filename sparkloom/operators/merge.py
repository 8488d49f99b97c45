"""Append-safe and three-way merges, point edits, re-pointing and exact differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ready


def append_safe(disk: DataFrame, memory: DataFrame, key: str) -> DataFrame:
    """All rows on disk, and of those in memory the ones with new keys."""
    return disk.unionByName(memory.join(disk.select(key), key, "left_anti"), allowMissingColumns=True)


def three_way(base: DataFrame, ours: DataFrame, disk: DataFrame, key: str) -> DataFrame:
    """Field by field: our value where we changed it since base, else the one on disk. Rows deleted by us stay deleted only if the disk's are unchanged."""
    fields = [c for c in base.columns if c != key]
    named = lambda df, p: df.select(key, F.lit(True).alias(f"{p}_in"), *[F.col(c).alias(f"{p}_{c}") for c in fields])
    all3 = named(base, "b").join(named(ours, "o"), key, "full").join(named(disk, "d"), key, "full")
    changed = F.lit(False)
    for c in fields:
        changed = changed | ~F.col(f"b_{c}").eqNullSafe(F.col(f"d_{c}"))
    gone = F.col("b_in").isNotNull() & F.col("o_in").isNull() & ~changed
    pick = lambda c: F.when(F.col("o_in").isNull(), F.col(f"d_{c}")).when(F.col("d_in").isNull() | F.col("b_in").isNull() & F.col("d_in").isNull() | ~F.col(f"o_{c}").eqNullSafe(F.col(f"b_{c}")), F.col(f"o_{c}")).otherwise(F.col(f"d_{c}"))
    return all3.where(~gone).select(key, *[pick(c).alias(c) for c in fields])


def apply_edits(df: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """``edits`` (key, column, value): the named cells replaced, all else untouched."""
    wide = edits.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("value")))).alias("_e"))
    joined = df.join(wide, key, "left")
    return joined.select(*[F.col(c) if c == key else F.when(F.map_contains_key("_e", F.lit(c)), F.col("_e")[c]["value"].cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in df.columns])


def exact_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that left and rows that came, with multiplicity."""
    return before.exceptAll(after).withColumn("side", F.lit("removed")).unionByName(after.exceptAll(before).withColumn("side", F.lit("added")))


def stub_duplicates(rows: DataFrame, pairs: DataFrame, key: str, pointer: str, codes: Sequence[str]) -> DataFrame:
    """Duplicates keep their id and get codes NA and a pointer to the original. ``pairs``: (key, original)."""
    out = rows.join(pairs, key, "left")
    dup = F.col("original").isNotNull()
    return out.select(*[F.when(dup, F.col("original")).otherwise(F.col(c)).alias(c) if c == pointer else F.when(dup, "NA").otherwise(F.col(c)).alias(c) if c in codes else F.col(c) for c in rows.columns])


def repoint(records: DataFrame, key: str, refs: str, pairs: DataFrame) -> DataFrame:
    """Array references moved from duplicate to original in place, without repeats. ``pairs``: (dup, original)."""
    each = records.select(key, F.posexplode(refs).alias("pos", "ref")).join(pairs, F.col("ref") == F.col("dup"), "left")
    new = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("original", "ref").alias("ref")))).alias("r")).select(key, F.array_distinct(F.transform("r", lambda x: x["ref"])).alias("_new"))
    return records.join(new, key, "left").withColumn(refs, F.coalesce("_new", refs)).drop("_new")


def upsert(df: DataFrame, news: DataFrame, key: str) -> DataFrame:
    return df.join(news.select(key), key, "left_anti").unionByName(news, allowMissingColumns=True)


def trail(entries: DataFrame, key: str, item: str, score: str, most: int = 25) -> DataFrame:
    """Per key the best ``most`` distinct items."""
    best = entries.groupBy(key, item).agg(F.max(score).alias(score))
    return best.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), item))).where(F.col("_k") <= most).drop("_k")


def numbered(df: DataFrame, order: Sequence[str], name: str = "number") -> DataFrame:
    """Rows numbered from 1 in ``order``: ranges of the order are counted and numbered each on its own, so that no task holds all rows."""
    ready(df.sparkSession)
    parts = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).checkpoint()  # the ranges must not move
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_own", own).join(F.broadcast(counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))), "_part").withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_part", "_own", "_before")


def next_ids(existing: DataFrame, new: DataFrame, column: str, prefix: str, order: Sequence[str]) -> DataFrame:
    """New rows numbered on from the highest number with the prefix, two digits at least."""
    top = existing.agg(F.coalesce(F.max(F.regexp_extract(column, f"^{prefix}(\\d+)$", 1).try_cast("int")), F.lit(0)).alias("top"))
    return numbered(new, order, "_number").join(F.broadcast(top)).withColumn(column, F.format_string(prefix + "%02d", F.col("top") + F.col("_number"))).drop("top", "_number")


def edit_field(records: DataFrame, key: str, edits: DataFrame, column: str = "record") -> DataFrame:
    """JSON records with some fields replaced and all others as they were. ``edits`` (key, field, value)."""
    wide = edits.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_e"))
    old = F.from_json(column, "map<string,string>")
    return records.join(wide, key, "left").withColumn(column, F.when(F.col("_e").isNull(), F.col(column)).otherwise(F.to_json(F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key("_e", k)), "_e")))).drop("_e")
