"""Parsers and scalar functions applied to whole columns, and estimators without SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coded, metrics, text
from ..operators import estimators
from .reports import _t


def q_enum_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    code = F.regexp_extract("o_orderpriority", r"^([1-5])", 1).cast("int")
    return o.groupBy(code.alias("level"), coded.year_bucket(F.year("o_orderdate")).alias("bucket")).agg(F.count("*").alias("n"))


def q_metric_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric texts made of line items' figures, parsed and counted by type."""
    l = _t(spark, sf_dir, "lineitem")  # noqa: E741
    shape = F.when(F.col("l_linenumber") == 1, F.format_string("AUC %s (95%% CI)", F.col("l_discount").cast("string"))).when(F.col("l_linenumber") == 2, F.format_string("no accuracy; HR %s", F.col("l_quantity").cast("string"))).when(F.col("l_linenumber") == 3, F.format_string("accuracy = %s%%", F.col("l_quantity").cast("string"))).otherwise("not reported: AUC 0.9")
    texts = l.groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))  # each text is parsed once
    parsed = texts.withColumn("m", metrics.metric_parse(F.col("shape")))
    return parsed.groupBy(F.coalesce("m.mtype", F.lit("UNKNOWN")).alias("mtype")).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("m.value") * F.col("n")), 6).alias("total"))


def q_dataset_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' names as single-centre cohorts."""
    c = _t(spark, sf_dir, "customer").join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(metrics.dataset_family(F.concat_ws(" ", "n_name", F.when(F.col("c_custkey") % 9 == 0, "adni-2"))).alias("family")).agg(F.count("*").alias("n"))


def q_section_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts split into lines, numbered, with their first words."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.groupBy("pos").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("n_chars"), F.countDistinct(F.substring_index("line", " ", 1)).alias("n_heads"))


def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"), F.count_if(F.get_json_object("props", "$.none").isNull()).alias("n_none"))


def q_title_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(text.norm_title(F.col("text")).alias("t"))
    return d.groupBy(F.length("t").alias("size")).agg(F.count("*").alias("n"), F.countDistinct("t").alias("n_distinct"))


def q_html_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of pages by regular expression."""
    p = _t(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return p.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


def q_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.md5("url").alias("md5"))


def q_ctmc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-state Markov rates of event types, the error state absorbing."""
    from ..operators import longitudinal as lon

    e = _t(spark, sf_dir, "events").where("event_type in ('view', 'click', 'error')")
    v = e.select("user_id", "event_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 8.64e10).alias("d"), F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3).alias("s"))
    return estimators.ctmc(lon.panel(lon.transitions(v, "user_id", ["ts", "event_id"], "s", "d", 3)))


def q_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile interval of kappa between two readers."""
    return estimators.kappa_bootstrap(_t(spark, sf_dir, "labels"), "quality", "toxic")


QUERIES = {f.__name__: f for f in (q_enum_parse, q_metric_parse, q_dataset_family, q_section_map, q_json_props, q_title_norm, q_html_leaves, q_digest, q_ctmc, q_bootstrap)}

SQL = {
    "q_dataset_family": """
WITH f AS (SELECT upper(n_name || CASE WHEN c_custkey % 9 = 0 THEN ' adni-2' ELSE '' END) AS t FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT CASE WHEN contains(t, 'ADNI') THEN 'ADNI' ELSE 'single-centre' END AS family, count(*) AS n FROM f GROUP BY 1""",
    "q_enum_parse": "SELECT regexp_extract(o_orderpriority, '^([1-5])', 1)::INT AS level, CASE WHEN year(o_orderdate) < 2021 THEN 'early' ELSE year(o_orderdate)::VARCHAR END AS bucket, count(*) AS n FROM orders GROUP BY 1, 2",
    "q_metric_parse": """
WITH m AS (SELECT CASE l_linenumber WHEN 1 THEN 'AUC' WHEN 2 THEN 'HR' WHEN 3 THEN CASE WHEN l_quantity <= 1.5 OR l_quantity / 100 <= 1 THEN 'ACC' ELSE 'UNKNOWN' END ELSE 'UNKNOWN' END AS mtype,
  CASE l_linenumber WHEN 1 THEN l_discount WHEN 2 THEN l_quantity WHEN 3 THEN CASE WHEN l_quantity > 1.5 THEN l_quantity / 100 ELSE l_quantity END END AS value FROM lineitem)
SELECT mtype, count(*) AS n, round(sum(value), 6) AS total FROM m GROUP BY 1""",
    "q_section_map": "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS pos FROM documents) SELECT pos, count(*) AS n, sum(length(line))::BIGINT AS n_chars, count(DISTINCT split_part(line, ' ', 1)) AS n_heads FROM l GROUP BY 1",
    "q_json_props": "SELECT event_type, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS k, count(*) FILTER ((props::JSON ->> '$.none') IS NULL) AS n_none FROM events GROUP BY 1",
    "q_title_norm": "WITH d AS (SELECT trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents) SELECT length(t)::INT AS size, count(*) AS n, count(DISTINCT t) AS n_distinct FROM d GROUP BY 1",
    "q_html_leaves": "WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) SELECT tag, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM p GROUP BY 1",
    "q_digest": "SELECT page_id, sha256(html) AS sha256, md5(url) AS md5 FROM pages",
}
