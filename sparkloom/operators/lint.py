"""Data-quality rules: messages per record, tallies, missing ids, repairs and hard stops."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def messages(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that hold (null counts as not)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))


def lint(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """(keys, rule): one row per violation, in one pass."""
    return df.select(*keys, F.explode(messages(rules)).alias("rule"))


def tally(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count("*").alias("n"))


def missing_ids(df: DataFrame, key: str) -> DataFrame:
    """Integers between the least and the greatest key that no row has: gaps between neighbours, expanded where they are."""
    from pyspark.sql import Window

    ids = df.select(F.col(key).cast("bigint").alias(key)).distinct()
    part = F.floor(F.col(key) / 100_000)  # neighbours are sought within parts, whose ends are added
    ends = ids.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    parts = ends.select(F.explode(F.sequence(F.floor(F.col("lo") / 100_000), F.floor(F.col("hi") / 100_000))).alias("p"), "lo", "hi")
    marks = parts.select("p", F.greatest(F.col("p") * 100_000, "lo").alias(key), F.lit(0).alias("real")).unionByName(parts.select("p", (F.least((F.col("p") + 1) * 100_000, F.col("hi") + 1)).alias(key), F.lit(0).alias("real")))
    every = ids.select(part.alias("p"), key, F.lit(1).alias("real")).unionByName(marks).groupBy("p", key).agg(F.max("real").alias("real"))
    nxt = every.withColumn("next", F.lead(key).over(Window.partitionBy("p").orderBy(key)))
    start = F.when(F.col("real") == 1, F.col(key) + 1).otherwise(F.col(key))
    return nxt.where(F.col("next").isNotNull() & (start < F.col("next"))).select(F.explode(F.sequence(start, F.col("next") - 1)).alias(key))


def repair_ids(df: DataFrame, refs: str, valid: DataFrame, key: str) -> DataFrame:
    """References to unknown ids become UNRESOLVED, in place."""
    each = df.select(key, F.posexplode_outer(refs).alias("pos", "ref")).join(valid.select(F.col(valid.columns[0]).alias("ref"), F.lit(True).alias("ok")).distinct(), "ref", "left")
    fixed = each.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.when(F.col("ok"), F.col("ref")).otherwise("UNRESOLVED").alias("ref"))))).alias("r"))
    return df.drop(refs).join(fixed.select(key, F.transform("r", lambda x: x["ref"]).alias(refs)), key, "left")


def stop_on(found: DataFrame, hard: Sequence[str]) -> int:
    """Number of soft violations; raises when a hard rule is violated."""
    counts = {r["rule"]: r["n"] for r in tally(found).collect()}  # one row a rule
    bad = {k: v for k, v in counts.items() if k in hard}
    if bad:
        raise ValueError(f"hard rules violated: {bad}")
    return sum(counts.values())


def unexpected(df: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """(key, field, expected, found) of ``expected`` (key, field, value, how) that a table does not hold: ``how`` is equals, contains or empty. A key without a row is found null."""
    fields = [c for c in df.columns if c != key]
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("found")) for c in fields])).alias("f")).select(key, "f.field", "f.found")
    both = expected.join(long, [key, "field"], "left")
    found = F.coalesce("found", F.lit(""))
    holds = F.when(F.col("how") == "contains", F.contains(found, F.col("value"))).when(F.col("how") == "empty", found == "").otherwise(F.coalesce(found.try_cast("double") == F.col("value").try_cast("double"), found == F.col("value")))
    return both.where(~holds | F.col("found").isNull() & (F.col("how") != "empty")).select(key, "field", F.col("value").alias("expected"), "found")


def off_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, reason) of manifest rows (path, sha256) whose file is missing or has another digest. ``files`` (path, content) as a binary source gives them."""
    own = files.select("path", F.sha2("content", 256).alias("found"))
    return manifest.join(own, "path", "left").where(F.col("found").isNull() | (F.col("found") != F.col("sha256"))).select("path", F.when(F.col("found").isNull(), "missing").otherwise("digest differs").alias("reason"))


def disagreeing(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """(key, a, b) of results that two tables do not share or in which they differ by more than ``tolerance``."""
    x, y = (d.select(key, F.col(value).cast("double").alias(n)) for d, n in ((a, "a"), (b, "b")))
    return x.join(y, key, "full").where(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > tolerance))
