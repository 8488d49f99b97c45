"""Count, share, threshold and statistics tables over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import aggregates


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q_crosstab_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.crosstab(_t(spark, sf_dir, "orders"), F.year("o_orderdate"), "o_orderstatus", ["F", "O", "P"], "o_year")


def q_cond_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.conditional_share(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_discount") >= 0.05)


def q_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.quartiles(_t(spark, sf_dir, "documents"), "n_chars", ["lang"])


def q_two_dim_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    return aggregates.cells(c, n, c.select("c_mktsegment").distinct(), "c_nationkey", "c_mktsegment")


def q_dual_code_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.coded_matrix(_t(spark, sf_dir, "documents"), F.array("lang", "source"), "lang")


def q_monopoly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.monopolies(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


CUTS = (50_000, 100_000, 200_000, 300_000, 400_000)


def q_threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.threshold_table(_t(spark, sf_dir, "orders"), "o_totalprice", CUTS, F.col("o_orderpriority") == "1-URGENT")


def q_survival_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels"), "doc_id")
    return aggregates.surviving_groups(d, "source", F.col("quality") == 1)


def q_confusion_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.confusion(_t(spark, sf_dir, "labels"), "quality", "toxic")


def q_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang").join(_t(spark, sf_dir, "labels"), "doc_id")
    k = d.groupBy("lang").agg(F.sum("quality").cast("bigint").alias("k"), F.count("*").alias("n"))
    return k.withColumn("w", stats.wilson(F.col("k"), F.col("n"))).select("lang", "k", "n", "w.p", "w.low", "w.high")


def q_hm_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality share as an AUC-like figure per source, its error, and z against the next source."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels"), "doc_id")
    k = d.groupBy("source").agg(F.avg("quality").alias("auc"), F.sum("quality").cast("bigint").alias("n1"), (F.count("*") - F.sum("quality")).cast("bigint").alias("n2")).where("n1 > 0 and n2 > 0")
    k = k.withColumn("se", stats.hanley_mcneil(F.col("auc"), F.col("n1"), F.col("n2"))).withColumn("se_p", stats.binomial_se(F.col("auc"), F.col("n1") + F.col("n2")))
    a, b = (k.select(*[F.col(c).alias(f"{c}_{x}") for c in k.columns]) for x in "ab")
    return a.join(b, F.col("source_a") < F.col("source_b")).select("source_a", "source_b", "se_a", "se_b", "se_p_a", stats.z_score(F.col("auc_a"), F.col("se_a"), F.col("auc_b"), F.col("se_b")).alias("z"))


PREVALENCES = (0.05, 0.084, 0.2)


def q_bayes_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readers' sensitivity and specificity carried to set prevalences."""
    r = _t(spark, sf_dir, "labels").agg(F.try_divide(F.count_if(F.expr("quality = 1 and toxic = 0")), F.count_if(F.expr("toxic = 0"))).alias("sens"), F.try_divide(F.count_if(F.expr("quality = 0 and toxic = 1")), F.count_if(F.expr("toxic = 1"))).alias("spec"))
    grid = r.withColumn("prevalence", F.explode(F.array(*map(F.lit, PREVALENCES))))
    return grid.withColumn("x", stats.transport(F.col("sens"), F.col("spec"), F.col("prevalence"))).select("prevalence", "x.tp", "x.fp", "x.tn", "x.fn", "x.ppv", "x.npv", "x.fp_per_tp")


def q_smd(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return aggregates.weighted_smd(c, "c_acctbal", F.col("c_custkey") % 7 + 1, F.col("c_mktsegment") == "BUILDING")


def q_ess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.effective_size(_t(spark, sf_dir, "lineitem"), "l_quantity", ["l_linestatus"])


def q_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.anchor_terms(_t(spark, sf_dir, "documents"), text.tokens(F.col("text"), []), "doc_id")


def q_sensitivity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "lineitem")
    return aggregates.sensitivity_grid(o, "l_discount", {"low": F.lit(0.03), "mid": F.lit(0.05), "tax": F.col("l_tax")}, {"all": F.lit(True), "returned": F.col("l_returnflag") == "R"})


QUERIES = {f.__name__: f for f in (q_crosstab_share, q_cond_share, q_quartiles, q_two_dim_cells, q_dual_code_matrix, q_monopoly, q_threshold_table, q_survival_of_groups, q_confusion_kappa, q_wilson, q_hm_se, q_bayes_grid, q_smd, q_ess, q_doc_freq, q_sensitivity_grid)}

SQL = {
    "q_crosstab_share": """
WITH c AS (SELECT year(o_orderdate)::INT AS o_year, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1)
SELECT *, 100.0::DOUBLE * n_f / (n_f + n_o + n_p) AS pct_f, 100.0::DOUBLE * n_o / (n_f + n_o + n_p) AS pct_o, 100.0::DOUBLE * n_p / (n_f + n_o + n_p) AS pct_p FROM c""",
    "q_cond_share": "SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_discount >= 0.05) AS n_true, 100.0::DOUBLE * count(*) FILTER (l_discount >= 0.05) / count(*) AS pct FROM lineitem GROUP BY 1",
    "q_quartiles": "SELECT lang, count(n_chars) AS n, quantile_cont(n_chars, 0.25)::DOUBLE AS q25, quantile_cont(n_chars, 0.5)::DOUBLE AS median, quantile_cont(n_chars, 0.75)::DOUBLE AS q75 FROM documents GROUP BY 1",
    "q_two_dim_cells": """
SELECT n.n_nationkey AS c_nationkey, s.c_mktsegment, count(c.c_custkey) AS n, count(c.c_custkey) <= 1 AS sparse
FROM nation n CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_mktsegment = s.c_mktsegment GROUP BY 1, 2""",
    "q_dual_code_matrix": "SELECT code, lang AS value, count(*) AS n FROM (SELECT lang, unnest(list_distinct([lang, source])) AS code FROM documents) GROUP BY 1, 2 UNION ALL SELECT 'all', lang, count(*) FROM documents GROUP BY 2",
    "q_monopoly": "SELECT l_orderkey, count(*) AS n, min(l_returnflag) AS only FROM lineitem GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT l_returnflag) = 1",
    "q_threshold_table": f"SELECT cut::DOUBLE AS cut, count(*) FILTER (o_totalprice >= cut) AS n, count(*) FILTER (o_totalprice >= cut AND o_orderpriority = '1-URGENT') AS n_flag FROM orders, (VALUES {', '.join(f'({c})' for c in CUTS)}) t(cut) GROUP BY 1",
    "q_survival_of_groups": "SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS n_keep, count(*) FILTER (quality = 1) >= 3 AS survives FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "q_confusion_kappa": """
WITH c AS (SELECT count(*) FILTER (quality = 0 AND toxic = 0) AS n00, count(*) FILTER (quality = 0 AND toxic = 1) AS n01, count(*) FILTER (quality = 1 AND toxic = 0) AS n10, count(*) FILTER (quality = 1 AND toxic = 1) AS n11 FROM labels),
e AS (SELECT *, (n00 + n11)::DOUBLE / (n00 + n01 + n10 + n11) AS accuracy, ((n00 + n01) * (n00 + n10) + (n10 + n11) * (n01 + n11))::DOUBLE / ((n00 + n01 + n10 + n11) * (n00 + n01 + n10 + n11)) AS pe FROM c)
SELECT n00, n01, n10, n11, accuracy, CASE WHEN pe < 1 THEN (accuracy - pe) / (1 - pe) END AS kappa FROM e""",
    "q_wilson": """
WITH k AS (SELECT lang, sum(quality)::BIGINT AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), p AS (SELECT *, k::DOUBLE / n AS p FROM k),
m AS (SELECT *, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS mid, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n) AS half FROM p)
SELECT lang, k, n, p, (mid - half)::DOUBLE AS low, (mid + half)::DOUBLE AS high FROM m""",
    "q_hm_se": """
WITH k AS (SELECT source, avg(quality)::DOUBLE AS auc, sum(quality)::BIGINT AS n1, (count(*) - sum(quality))::BIGINT AS n2 FROM documents JOIN labels USING (doc_id) GROUP BY 1),
s AS (SELECT *, sqrt((auc * (1 - auc) + (n1 - 1) * (auc / (2 - auc) - auc * auc) + (n2 - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (n1 * n2)) AS se, sqrt(auc * (1 - auc) / (n1 + n2)) AS se_p FROM k WHERE n1 > 0 AND n2 > 0)
SELECT a.source AS source_a, b.source AS source_b, a.se AS se_a, b.se AS se_b, a.se_p AS se_p_a, CASE WHEN a.se * a.se + b.se * b.se > 0 THEN abs(a.auc - b.auc) / sqrt(a.se * a.se + b.se * b.se) END AS z FROM s a JOIN s b ON a.source < b.source""",
    "q_bayes_grid": f"""
WITH r AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0)::DOUBLE / count(*) FILTER (toxic = 0) AS sens, count(*) FILTER (quality = 0 AND toxic = 1)::DOUBLE / count(*) FILTER (toxic = 1) AS spec FROM labels),
c AS (SELECT p AS prevalence, sens * p AS tp, (1 - spec) * (1 - p) AS fp, spec * (1 - p) AS tn, (1 - sens) * p AS fn FROM r, (VALUES {', '.join(f'({p}::DOUBLE)' for p in PREVALENCES)}) t(p))
SELECT *, tp / (tp + fp) AS ppv, tn / (tn + fn) AS npv, fp / tp AS fp_per_tp FROM c""",
    "q_smd": """
WITH c AS (SELECT c_acctbal AS x, (c_custkey % 7 + 1)::DOUBLE AS w, c_mktsegment = 'BUILDING' AS t FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
m AS (SELECT sum(w * x) FILTER (t) / sum(w) FILTER (t) AS mean_t, sum(w * x) FILTER (NOT t) / sum(w) FILTER (NOT t) AS mean_c, var_pop(x) FILTER (t) AS vt, var_pop(x) FILTER (NOT t) AS vc FROM c)
SELECT mean_t, mean_c, (mean_t - mean_c) / sqrt((vt + vc) / 2) AS smd FROM m""",
    "q_ess": "SELECT l_linestatus, count(*) AS n, sum(l_quantity) * sum(l_quantity) / sum(l_quantity * l_quantity) AS ess FROM lineitem GROUP BY 1",
    "q_doc_freq": """
WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]{2,}'))) AS term FROM documents)
SELECT term, count(*) AS df FROM t GROUP BY 1 HAVING count(*) <= greatest(3, floor(0.03 * (SELECT count(*) FROM documents))) AND (length(term) >= 7 OR contains(term, '-'))""",
    "q_sensitivity_grid": """
SELECT rule, policy, count(*) FILTER (l_discount + 1e-12 >= CASE rule WHEN 'low' THEN 0.03 WHEN 'mid' THEN 0.05 ELSE l_tax END AND (policy = 'all' OR l_returnflag = 'R')) AS n
FROM lineitem, (VALUES ('low'), ('mid'), ('tax')) r(rule), (VALUES ('all'), ('returned')) p(policy) GROUP BY 1, 2""",
}
