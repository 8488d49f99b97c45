"""Operator 2: URL filters by host-suffix and path-prefix expressions.

Each url is expanded into (host suffix, path prefix) expressions, equi-joined to the rules on
a short prefix of the expression's SHA-256 and then confirmed by the full digest; among the
rules that fit, the longest wins. DataFrame functions only.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and
gets the default verdict; repeated rows come back as often as they came in; rules of one
length are ranked by the longer host, then block before allow; an empty table gives no rows;
other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LOWER, UPPER, ascii_lower, saved, table

#: (verdict, host/path)
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Hex digits of the digest that the join compares.
SHORT = 8


def url_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(F.col(url)))).otherwise(F.lit(""))
    return pages.withColumn("_rest", rest).withColumns({
        "host": ascii_lower(F.regexp_extract("_rest", r"^[^/?#]*", 0)),
        "path": F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1),
    }).drop("_rest")


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rules with their digests; ``rank`` orders those that fit one url."""
    rows = spark.createDataFrame([(v, r) for v, r in dict.fromkeys(rules)], "verdict string, rule string")
    cut = F.instr("rule", "/")
    rows = rows.select("verdict", F.when(cut > 0, ascii_lower(F.expr("substring(rule, 1, instr(rule, '/') - 1)"))).otherwise(ascii_lower(F.col("rule"))).alias("r_host"), F.when(cut > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("").alias("r_path"))
    text = F.concat("r_host", "r_path")
    return rows.select(
        F.sha2(text, 256).alias("r_digest"),
        F.struct(F.length(text).alias("n"), F.length("r_host").alias("n_host"), (F.col("verdict") == "block").alias("block"), text.alias("rule"), F.col("verdict").alias("verdict")).alias("r_rank"),
        F.size(F.split("r_host", r"\.")).alias("labels"),
        F.length("r_path").alias("n_path"),
    )


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every row of ``pages``: (id, host, path, rule, verdict).

    ``rules`` are (verdict, rule) pairs or a table as ``rule_table`` makes it. Up to
    ``BROADCAST_ROWS`` rules are broadcast; more of them are joined by a shuffle of the distinct
    expressions' short digests, so that a host with a third of all rows counts once.
    """
    spark = pages.sparkSession
    rules = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    facts = rules.agg(F.count("*").alias("n"), F.max("labels").alias("labels"), F.collect_set("n_path").alias("lens")).first()
    parts = url_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    parts = parts.groupBy("page_id", "url", "host", "path").agg(F.count("*").alias("copies"))
    rules = rules.withColumn("short", F.substring("r_digest", 1, SHORT)).select("short", "r_digest", "r_rank")
    lens = F.array(*[F.lit(x) for x in sorted(facts["lens"])]).cast("array<int>")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(facts["labels"] or 1))), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    starts = F.transform(F.filter(lens, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    found = parts.where("host <> ''").select("host", "path").distinct().withColumn("end", F.explode(ends)).withColumn("start", F.explode(starts))
    found = found.select("host", "path", F.sha2(F.concat("end", "start"), 256).alias("digest")).withColumn("short", F.substring("digest", 1, SHORT))
    if facts["n"] <= BROADCAST_ROWS:
        found = found.join(F.broadcast(rules), "short").where("digest = r_digest").select("host", "path", "r_rank")
    else:
        hits = found.select("digest", "short").distinct().join(rules, "short").where("digest = r_digest").groupBy("digest").agg(F.max("r_rank").alias("r_rank"))
        found = found.join(hits, "digest").select("host", "path", "r_rank")
    # saved, so that Spark can split a host and path with very many pages on the other side of the join
    best = saved(found.groupBy("host", "path").agg(F.max("r_rank").alias("best")).withColumn("salt", F.lit(0)), "best")
    # pages without a host are judged by nothing: they are spread, not sent to one key
    salt = F.when(F.col("host") == "", F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)).cast("int") + 1).otherwise(0)
    judged = parts.withColumn("salt", salt).join(best, ["host", "path", "salt"], "left").withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(verdict, h, p) AS (
  VALUES {", ".join(f"('{v}', '{r[: r.index('/')]}', '{r[r.index('/') :]}')" for v, r in RULES)}
), hits AS (
  SELECT k, h || p AS rule, verdict, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC, length(h) DESC, verdict DESC) AS nth
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM hits WHERE nth = 1) USING (k)
"""
