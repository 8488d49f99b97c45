"""Merges, edits, lints and set operations on ledgers; driver tables stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lint, merge
from .reports import _t


def q_merge_3way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base, a memory copy with raised balances and new segments, and a disk copy edited meanwhile."""
    base = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    ours = base.where("c_custkey % 50 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 100).otherwise(F.col("c_acctbal")))
    disk = base.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, "DISK").otherwise(F.col("c_mktsegment"))).withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.lit(0.0)).otherwise(F.col("c_acctbal")))
    return merge.three_way(base, ours, disk, "c_custkey")


def q_append_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier")
    return merge.append_safe(s.where("s_suppkey % 3 <> 0"), s.where("s_suppkey % 2 = 0").withColumn("s_acctbal", F.lit(0.0)), "s_suppkey").select("s_suppkey", "s_acctbal")


def q_repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' part lists with every part re-pointed to the first part of its name and brand."""
    p = _t(spark, sf_dir, "part")
    lead = p.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("original"))
    pairs = p.join(lead, ["p_name", "p_brand"]).where("p_partkey <> original").select(F.col("p_partkey").alias("dup"), "original")
    refs = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    out = merge.repoint(refs, "l_orderkey", "parts", pairs)
    return out.select("l_orderkey", F.array_join("parts", ",").alias("parts"))


def q_exact_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    edits = s.where("s_suppkey % 10 = 0").select("s_suppkey", F.lit("s_nationkey").alias("column"), F.lit("7").alias("value"))
    return merge.exact_diff(s, merge.apply_edits(s, edits, "s_suppkey"))


def q_stub_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.lit(None).cast("bigint").alias("duplicate_of"))
    lead = p.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("original"))
    pairs = p.select("p_partkey", "p_name", "p_brand").join(lead, ["p_name", "p_brand"]).where("p_partkey <> original").select("p_partkey", "original")
    return merge.stub_duplicates(p, pairs, "p_partkey", "duplicate_of", ["p_type"])


def q_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.trail(_t(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", "l_extendedprice").select("l_suppkey", "l_partkey", "l_extendedprice")


def q_lint_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _t(spark, sf_dir, "lineitem")  # noqa: E741
    rules = {
        "discount high": F.col("l_discount") > 0.09,
        "tax with no discount": (F.col("l_discount") == 0) & (F.col("l_tax") > 0.05),
        "price off": F.col("l_extendedprice") < 2_000,
        "flag unknown": ~F.col("l_returnflag").isin("A", "N"),
    }
    return lint.tally(lint.lint(l, ["l_orderkey"], rules))


def q_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.missing_ids(_t(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey")


def q_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = lambda p: (F.col(f"{p}_nationkey") * 1000 + F.floor(F.col(f"{p}_acctbal") / 500)).cast("bigint").alias("k")
    c, s = _t(spark, sf_dir, "customer").select(band("c")), _t(spark, sf_dir, "supplier").select(band("s"))
    named = lambda d, n: d.select(F.lit(n).alias("op"), "k")
    return named(c.union(s).distinct(), "union").unionByName(named(c.intersect(s), "intersect")).unionByName(named(c.subtract(s), "except")).unionByName(named(s.subtract(c), "reverse"))


QUERIES = {f.__name__: f for f in (q_merge_3way, q_append_safe, q_repoint, q_exact_diff, q_stub_duplicates, q_trail, q_lint_rules, q_missing_ids, q_set_ops)}

SQL = {
    "q_merge_3way": """
WITH b AS (SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey FROM customer), o AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS bal FROM b WHERE c_custkey % 50 <> 0),
d AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS bal, CASE WHEN c_custkey % 4 = 0 THEN 'DISK' ELSE c_mktsegment END AS seg, c_nationkey FROM b)
SELECT c_custkey, CASE WHEN o.c_custkey IS NOT NULL AND c_custkey % 3 = 0 THEN o.bal ELSE d.bal END AS c_acctbal, seg AS c_mktsegment, d.c_nationkey
FROM d JOIN b USING (c_custkey) LEFT JOIN o USING (c_custkey) WHERE NOT (o.c_custkey IS NULL AND d.bal = b.c_acctbal AND d.seg = b.c_mktsegment)""",
    "q_append_safe": "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, 0.0::DOUBLE FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 0",
    "q_repoint": """
WITH m AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS o FROM part), r AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
x AS (SELECT l_orderkey, coalesce(o, l_partkey) AS ref, min(l_partkey) AS pos FROM r LEFT JOIN m ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT l_orderkey, string_agg(ref::VARCHAR, ',' ORDER BY pos) AS parts FROM x GROUP BY 1""",
    "q_exact_diff": "SELECT s_suppkey, s_name, s_nationkey, 'removed' AS side FROM supplier WHERE s_suppkey % 10 = 0 AND s_nationkey <> 7 UNION ALL SELECT s_suppkey, s_name, 7, 'added' FROM supplier WHERE s_suppkey % 10 = 0 AND s_nationkey <> 7",
    "q_stub_duplicates": "WITH m AS (SELECT *, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS o FROM part) SELECT p_partkey, p_name, p_brand, CASE WHEN o <> p_partkey THEN 'NA' ELSE p_type END AS p_type, CASE WHEN o <> p_partkey THEN o END AS duplicate_of FROM m",
    "q_trail": "SELECT l_suppkey, l_partkey, l_extendedprice FROM (SELECT l_suppkey, l_partkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_partkey) <= 25",
    "q_lint_rules": """
SELECT 'discount high' AS rule, count(*) AS n FROM lineitem WHERE l_discount > 0.09 HAVING count(*) > 0 UNION ALL SELECT 'tax with no discount', count(*) FROM lineitem WHERE l_discount = 0 AND l_tax > 0.05 HAVING count(*) > 0
UNION ALL SELECT 'price off', count(*) FROM lineitem WHERE l_extendedprice < 2000 HAVING count(*) > 0 UNION ALL SELECT 'flag unknown', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') HAVING count(*) > 0""",
    "q_missing_ids": "SELECT unnest(range((SELECT min(l_orderkey) FROM lineitem), (SELECT max(l_orderkey) + 1 FROM lineitem))) AS l_orderkey EXCEPT SELECT l_orderkey FROM lineitem",
    "q_set_ops": """
WITH c AS (SELECT DISTINCT (c_nationkey * 1000 + floor(c_acctbal / 500))::BIGINT AS k FROM customer), s AS (SELECT DISTINCT (s_nationkey * 1000 + floor(s_acctbal / 500))::BIGINT AS k FROM supplier)
SELECT 'union' AS op, k FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT 'intersect', k FROM c WHERE k IN (SELECT k FROM s) UNION ALL SELECT 'except', k FROM c WHERE k NOT IN (SELECT k FROM s) UNION ALL SELECT 'reverse', k FROM s WHERE k NOT IN (SELECT k FROM c)""",
}
