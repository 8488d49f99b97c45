"""Records from sections, adjudication, filters, archives and pages, greedy selection, and fits that SQL repeats step by step."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coded, detect, text
from ..operators import aggregates, cohort, evidence, extraction, registry_flow, selection
from ..operators import longitudinal as lon
from ..session import shared_path
from ..sources import paged, readers
from .people import _P, _paths
from .prose import _ABSENT, _BEST, _DENIED, _M2, CONVERSION_SQL, LABEL_SQL, METRIC_SQL, POPULATION_SQL, PROSE, _design, _q, prose
from .reports import _t
from .texts import _tok
from .world import ctes, world


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    code = lambda letter, n: F.concat(F.when(k % 3 == 0, "Assigned: ").when(k % 3 == 1, "").otherwise("as in "), F.lit(letter), (k % n + 1).cast("string"), F.lit(" - because"))
    return prose(spark, sf_dir).select(
        F.concat(F.lit("P-"), k.cast("string")).alias("pid"), F.when(k % 7 > 0, F.concat(F.when(k % 2 == 0, "C2 and C4 - ").otherwise("Assigned: C3 (label) - "), "modality")).alias("modality"), code("T", 6).alias("task"), code("V", 4).alias("validation"), code("A", 8).alias("architecture"),
        F.when(k % 4 == 0, F.concat(F.lit("Assigned: "), "best")).when(k % 4 == 1, F.col("best")).alias("metric"), F.when(k % 5 == 0, "Assigned: 0.91 (test)").when(k % 5 == 1, "NR. none").when(k % 5 == 2, "about ninety").otherwise("").alias("auc"), F.col("opening").alias("dataset"),
        F.when(k % 2 == 0, "Assigned = 120 adults").otherwise("** 77").alias("size"), F.when(k % 3 == 0, "Assigned: Yes, it is").when(k % 3 == 1, "False").otherwise("maybe").alias("adni"), F.concat(F.lit("a new way (31 characters)\n\nwhy"), k.cast("string")).alias("novelty"),
        F.col("evidence").alias("limitation"), F.lit("").alias("venue"), F.col("dated").alias("year"),
    )


def q_explicit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.explicit_fields(_sections(spark, sf_dir))


def q_local_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows made of blocks alone, then held to their vocabularies with notes."""
    blocks = prose(spark, sf_dir).select(F.concat(F.lit("P-"), F.col("k").cast("string")).alias("pid"), "title_line", "opening", "body")
    rows = extraction.normalised_record(extraction.local_record(blocks, _sections(spark, sf_dir)))
    return rows.select("pid", "Task_Type", "Validation_Type", "Architecture_Family", "Key_Novelty", "XAI_Method", "study_design_type", "population_specificity", "task_substage", "duplicate_of", F.size("notes").alias("n_notes"))


def q_vocabulary_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields outside a vocabulary or too wide, replaced and noted."""
    r = world(spark, sf_dir, "registry")
    out = extraction.normalised(r, {"task_substage": ("MCI_vs_HC", "MCI_to_AD"), "XAI_Method": ("SHAP", "LIME")}, {"Key_Novelty": 40})
    return out.select("Paper_ID", "task_substage", "XAI_Method", "Key_Novelty", F.array_join("notes", "; ").alias("notes"))


def q_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A worksheet against its key, without excluded and unblinded items: agreement by kind and policy."""
    k = F.col("o_orderkey")
    sheet = _t(spark, sf_dir, "orders").select(k.alias("item"), F.when(k % 3 == 0, " Admit").when(k % 3 == 1, "reject").when(k % 6 == 2, "rescope").otherwise("").alias("verdict"), F.when(k % 40 == 3, "[nonblind] seen").alias("note"))
    key = _t(spark, sf_dir, "orders").select(k.alias("item"), F.when(F.col("o_totalprice") > 200_000, "admit").otherwise("reject").alias("first_reader"), F.col("o_orderpriority").alias("kind"))
    left_out = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("item"))
    return aggregates.adjudicated(sheet, key, left_out)


def q_paper_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers named by number or id."""
    n = _t(spark, sf_dir, "nation")
    tokens = n.select(F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit(" P-"), (F.col("n_nationkey") * 7).cast("string"))).when(F.col("n_nationkey") % 3 == 1, (F.col("n_nationkey") * 11).cast("string")).otherwise("p-5x").alias("token"))
    return coded.filtered(world(spark, sf_dir, "registry"), "Paper_ID", tokens, "token").select("Paper_ID", coded.paper_number(F.col("Paper_ID")).alias("number"))


def q_threshold_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers at or above each cut, split by external validation, with the ids of the external ones in order of number."""
    r = world(spark, sf_dir, "registry").withColumn("value", (F.col("k") % 100) / 100.0)
    return aggregates.threshold_ids(r, "value", (0.95, 0.97, 0.99), F.upper(F.trim("Validation_Type")).startswith("V4"), "Paper_ID", coded.paper_number(F.col("Paper_ID")))


def q_state_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People by which of two states they were seen in first, and covariates joined to each."""
    o = lon.state_order(_paths(spark, sf_dir), "person", "t", "state", 1, 2)
    c = _t(spark, sf_dir, "customer")
    parts = [c.select(F.col("c_custkey").alias("person"), "c_mktsegment"), _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("person")).agg(F.max("o_orderkey").alias("last_order"))]
    return cohort.left_merge(o, "person", parts).groupBy("c_mktsegment", "order").agg(F.count("*").alias("n"), F.max("last_order").alias("last_order"))


def q_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a search source read until the first empty one, each record with its count of citations from a table."""
    path = shared_path(spark, "pages")
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", F.floor(F.col("c_custkey") / 25).cast("int").alias("page"))
    c.where("page < 12 or page > 13").groupBy("page").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))).alias("records")).write.json(f"{path}/found")
    found = paged.search(spark, f"{path}/found", "c_custkey bigint, c_name string", lines=True)
    counts = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("citations"))
    return paged.with_counts(found, counts, "c_custkey", "citations")


def q_zip_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one CSV member of an archive."""
    path = f"{shared_path(spark, 'zip')}/tables.zip"
    body, rows = io.BytesIO(), _t(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("notes.txt", "no table")
        z.writestr("tables.csv", "key,name,extra\n" + "".join(f'{r["n_nationkey"]},"{r["n_name"]}, a nation",x\n' for r in rows))
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(body.getvalue()))
    out.close()
    return readers.zip_csv(spark, path, ["key", "name"]).select("key", "name")


def q_greedy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand, parts in order while fewer than five are kept, without those near a kept one."""
    p = _t(spark, sf_dir, "part").select("p_brand", "p_partkey", text.tokens(F.concat_ws(" ", "p_name", "p_type"), []).alias("tokens"))
    return selection.greedy_select(p, "p_brand", "p_partkey", "tokens", 5, 0.5).select("p_brand", "p_partkey")


def q_gap_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are out of scope, a known cell, a known pair, near a known statement, or new with an id."""
    k = F.col("s_suppkey")
    kinds = F.array(*[F.lit(x) for x in ("structural_absence", "combinatorial", "methodological")])
    cand = _t(spark, sf_dir, "supplier").select(
        k.alias("order"), F.get(kinds, (k % 3).cast("int")).alias("gap_type"), F.when(k % 3 == 0, F.concat(F.lit("m"), (k % 12).cast("string"))).alias("modality"), F.concat(F.lit("T"), (k % 2 + 1).cast("string")).alias("task_type"), F.concat(F.lit("P-"), (k % 30).cast("string")).alias("paper_a"), F.concat(F.lit("P-"), (k % 40).cast("string")).alias("paper_b"),
        F.when(k % 10 == 9, "needs a drug trial").otherwise(F.concat(F.lit("no cohort of type"), k.cast("string"), F.lit(" reads speech in town"), (k % 7).cast("string"))).alias("gap_statement"), F.lit("a study").alias("closure_criteria"), F.when(k % 2 == 0, "derived").otherwise("curated").alias("tier"),
    )
    n = F.col("n_nationkey")
    gaps = _t(spark, sf_dir, "nation").select(
        F.concat(F.lit("G-CAND-"), n.cast("string")).alias("id"), F.get(kinds, (n % 3).cast("int")).alias("gap_type"), F.when(n % 3 == 0, F.concat(F.lit("m"), (n % 12).cast("string"))).alias("modality"), F.lit("T1").alias("task_type"), F.concat(F.lit("P-"), (n + 4).cast("string")).alias("paper_a"), F.concat(F.lit("P-"), n.cast("string")).alias("paper_b"),
        F.concat(F.lit("no cohort reads speech in town"), (n % 7).cast("string")).alias("gap_statement"), F.when(n % 2 == 0, "derived").otherwise("curated").alias("tier"),
    )
    conflicts = _t(spark, sf_dir, "nation").select(F.concat(F.lit("P-"), n.cast("string")).alias("paper_a"), F.concat(F.lit("P-"), n.cast("string")).alias("paper_b"))
    return registry_flow.append_candidates(gaps, cand, conflicts).select("order", "outcome", "match", "id")


def q_denied_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger filters of the findings: consensus, complementary and genuine flags."""
    f = world(spark, sf_dir, "findings")
    s = world(spark, sf_dir, "support").groupBy("id").agg(F.collect_set("pid").alias("supporters"))
    d = f.join(s, "id", "left").withColumn("supporters", F.coalesce("supporters", F.array().cast("array<string>")))
    c = world(spark, sf_dir, "complementary")
    one = d.select(F.lit("consensus").alias("part"), "id", evidence.consensus_included(F.col("supporters"), F.col("manuscript_status"), F.col("status")).alias("kept"))
    return one.unionByName(c.select(F.lit("complementary").alias("part"), "id", evidence.complementary_included(F.col("status"), F.col("combined_insight")).alias("kept")))


QUERIES = {
    f.__name__: f
    for f in (
        q_explicit_fields, q_local_records, q_vocabulary_notes, q_adjudication, q_paper_filter, q_threshold_ids, q_state_order, q_citations, q_zip_member, q_greedy_select, q_gap_append, q_denied_claims,
    )
}

_SP = "WITH p AS (" + PROSE.format(orders="orders") + ")"


def _code(letter: str, n: int) -> str:
    return f"CASE WHEN k % 3 < 2 THEN '{letter}' || (k % {n} + 1)::VARCHAR END"


SQL = {
    "q_vocabulary_notes": ctes("registry") + """
SELECT Paper_ID, CASE WHEN trim(task_substage) IN ('MCI_vs_HC', 'MCI_to_AD') THEN trim(task_substage) ELSE 'NR' END AS task_substage, CASE WHEN trim(XAI_Method) IN ('SHAP', 'LIME') THEN trim(XAI_Method) ELSE 'NR' END AS XAI_Method, CASE WHEN length(Key_Novelty) <= 40 THEN Key_Novelty ELSE regexp_replace(substr(Key_Novelty, 1, 40), '\\s+\\S*$', '') END AS Key_Novelty,
  array_to_string(list_filter([CASE WHEN trim(task_substage) NOT IN ('MCI_vs_HC', 'MCI_to_AD') AND lower(trim(task_substage)) NOT IN ('', 'na', 'nr', 'n/a', 'not reported', 'none') THEN 'task_substage not in vocabulary: ' || trim(task_substage) END, CASE WHEN trim(XAI_Method) NOT IN ('SHAP', 'LIME') AND lower(trim(XAI_Method)) NOT IN ('', 'na', 'nr', 'n/a', 'not reported', 'none') THEN 'XAI_Method not in vocabulary: ' || trim(XAI_Method) END,
    CASE WHEN length(Key_Novelty) > 40 THEN 'Key_Novelty cut to 40' END], lambda v: v IS NOT NULL), '; ') AS notes FROM registry""",
    "q_adjudication": """
WITH s AS (SELECT o_orderkey AS item, CASE WHEN o_orderkey % 3 = 0 THEN 'admit' WHEN o_orderkey % 3 = 1 THEN 'reject' WHEN o_orderkey % 6 = 2 THEN 'rescope' END AS v, CASE WHEN o_totalprice > 200000 THEN 'admit' ELSE 'reject' END AS f, o_orderpriority AS kind FROM orders WHERE o_orderkey % 40 <> 3 AND o_orderkey NOT IN (SELECT n_nationkey FROM nation)),
e AS (SELECT p AS policy, k2 AS kind, f, CASE WHEN v = 'rescope' THEN p ELSE v END AS v FROM s, (VALUES ('admit'), ('reject')) t(p), LATERAL (SELECT unnest([kind, 'all']) AS k2) WHERE v IS NOT NULL)
SELECT policy, kind, count(*) AS n, count(*) FILTER (f = v) AS agree, count(*) FILTER (f = 'admit' AND v = 'admit') AS tp, count(*) FILTER (f <> 'admit' AND v = 'admit') AS fn, count(*) FILTER (f <> 'admit' AND v <> 'admit') AS tn, count(*) FILTER (f = 'admit' AND v <> 'admit') AS fp FROM e GROUP BY 1, 2""",
    "q_paper_filter": ctes("registry") + " SELECT Paper_ID, (k + 1)::INT AS number FROM registry WHERE k + 1 IN (SELECT n_nationkey * 7 FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_nationkey * 11 FROM nation WHERE n_nationkey % 3 = 1)",
    "q_threshold_ids": ctes("registry") + """, r AS (SELECT k, Paper_ID, (k % 100) / 100.0::DOUBLE AS v, starts_with(upper(trim(Validation_Type)), 'V4') AS x FROM registry)
SELECT cut::DOUBLE AS cut, count(*) AS n, count(*) FILTER (NOT x) AS internal, count(*) FILTER (x) AS external, coalesce(string_agg(Paper_ID, ', ' ORDER BY k) FILTER (x), '') AS ids FROM r, (VALUES (0.95::DOUBLE), (0.97::DOUBLE), (0.99::DOUBLE)) t(cut) WHERE v >= cut GROUP BY 1""",
    "q_state_order": _P + """, f AS (SELECT person, min(t) FILTER (state = 1) AS a, min(t) FILTER (state = 2) AS b FROM p GROUP BY 1),
o2 AS (SELECT person, CASE WHEN a IS NULL AND b IS NULL THEN 'neither' WHEN b IS NULL THEN 'a only' WHEN a IS NULL THEN 'b only' WHEN a < b THEN 'a first' WHEN b < a THEN 'b first' ELSE 'same time' END AS "order" FROM f), l AS (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders GROUP BY 1)
SELECT c_mktsegment, "order", count(*) AS n, max(last_order) AS last_order FROM o2 LEFT JOIN customer ON c_custkey = person LEFT JOIN l ON o_custkey = person GROUP BY 1, 2""",
    "q_citations": "SELECT c_custkey, (c_custkey // 25)::INT AS page, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS citations FROM customer WHERE c_custkey // 25 < 12",
    "q_zip_member": "SELECT n_nationkey::VARCHAR AS key, n_name || ', a nation' AS name FROM nation",
    "q_greedy_select": r"""
WITH RECURSIVE t AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z][a-z0-9\-]{2,}')) AS w FROM part),
g(p_brand, i, kept, ids) AS (SELECT p_brand, 1::BIGINT, [w], [p_partkey] FROM t WHERE i = 1 UNION ALL
  SELECT t.p_brand, t.i, CASE WHEN ok THEN list_append(kept, w) ELSE kept END, CASE WHEN ok THEN list_append(ids, p_partkey) ELSE ids END
  FROM (SELECT t.*, g.kept, g.ids, len(g.ids) < 5 AND len(list_filter(g.kept, lambda k: len(list_intersect(k, t.w)) >= 0.5 * greatest(1, len(list_distinct(k || t.w))))) = 0 AS ok FROM g JOIN t ON t.p_brand = g.p_brand AND t.i = g.i + 1) t)
SELECT p_brand, unnest(ids) AS p_partkey FROM (SELECT p_brand, arg_max(ids, i) AS ids FROM g GROUP BY 1)""",
    "q_denied_claims": ctes("findings", "support", "complementary") + """, n AS (SELECT id, count(*) AS n FROM support GROUP BY 1)
SELECT 'consensus' AS part, f.id, coalesce(n, 0) > 0 AND NOT (regexp_matches(lower(trim(coalesce(manuscript_status, ''))), 'exclu|candidate|pending') AND NOT starts_with(lower(trim(manuscript_status)), 'include')) AND NOT regexp_matches(lower(coalesce(status, '')), 'reject|retract|withdrawn') AS kept FROM findings f LEFT JOIN n USING (id)
UNION ALL SELECT 'complementary', id, coalesce(contains(lower(status), 'confirm') AND len(string_split_regex(trim(combined_insight), '\\s+')) >= 20, false) FROM complementary""",
    "q_explicit_fields": _SP + f""",
x AS (SELECT * REPLACE (CASE WHEN k % 2 = 0 THEN modality ELSE '(label) - ' || modality END AS modality) FROM p), d AS (SELECT *, {_M2} AS m FROM x)
SELECT 'P-' || k::VARCHAR AS pid, CASE WHEN k % 7 > 0 THEN CASE WHEN k % 2 = 0 THEN 'C2, C4' ELSE 'C3' END END AS Category, CASE WHEN k % 7 > 0 THEN coalesce({LABEL_SQL}, CASE WHEN k % 2 = 0 THEN {_q(detect.CATEGORY_LABELS['C2'])} ELSE {_q(detect.CATEGORY_LABELS['C3'])} END) END AS Modality,
  {_code('T', 6)} AS Task_Type, {_code('V', 4)} AS Validation_Type, {_code('A', 8)} AS Architecture_Family, CASE WHEN k % 4 = 0 THEN CASE WHEN best = '' THEN 'Assigned:' ELSE {METRIC_SQL} END WHEN k % 4 = 1 AND best <> '' THEN CASE WHEN {_ABSENT} OR {_DENIED} THEN 'NR' ELSE {_BEST} END END AS Best_Metric,
  CASE WHEN k % 5 = 0 THEN '0.91' WHEN k % 5 = 1 THEN 'NR' WHEN k % 5 = 2 THEN 'about ninety' END AS Best_AUC, trim(regexp_replace(opening, '\\s+', ' ', 'g')) AS Dataset, CASE WHEN k % 2 = 0 THEN '120 adults' ELSE '77' END AS Sample_N_Approx, CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS ADNI_Dependent,
  'a new way' AS Key_Novelty, CASE WHEN evidence <> '' THEN trim(regexp_replace(evidence, '\\s+', ' ', 'g')) END AS Primary_Limitation, NULL::VARCHAR AS Journal, nullif(regexp_extract(dated, '\\b(19[8-9]\\d|20[0-3]\\d)\\b', 1), '') AS Publication_Year FROM d""",
    "q_local_records": _SP + f""", l AS (SELECT *, lower(body) AS low, regexp_replace(lower(opening), {_q(detect.EXCLUSION)}, ' ', 'g') AS own FROM p)
SELECT 'P-' || k::VARCHAR AS pid, coalesce({_code('T', 6)}, 'T4') AS Task_Type, coalesce({_code('V', 4)}, 'V2') AS Validation_Type, coalesce({_code('A', 8)}, 'A1') AS Architecture_Family, 'a new way' AS Key_Novelty, 'none' AS XAI_Method, {_design()} AS study_design_type, {POPULATION_SQL} AS population_specificity,
  CASE coalesce({_code('T', 6)}, 'T4') WHEN 'T1' THEN 'MCI_vs_HC' WHEN 'T2' THEN {CONVERSION_SQL} WHEN 'T3' THEN 'multiclass_staging' WHEN 'T4' THEN 'biomarker_correlation' WHEN 'T5' THEN 'MCI_reversion' ELSE 'not reported' END AS task_substage,
  CASE WHEN k % 9 = 6 THEN 'P-' || (k % 90)::VARCHAR ELSE 'not reported' END AS duplicate_of, ((k % 4 < 2 AND k % 11 = 4 AND k % 120 <= 100)::INT + CASE WHEN k % 3 = 2 THEN 3 ELSE 0 END)::INT AS n_notes FROM l""",
    "q_gap_append": f"""
WITH ki AS (SELECT ['structural_absence', 'combinatorial', 'methodological'] AS a),
c AS (SELECT s_suppkey AS "order", a[s_suppkey % 3 + 1] AS ty, CASE WHEN s_suppkey % 3 = 0 THEN 'm' || (s_suppkey % 12)::VARCHAR END AS mo, 'T' || (s_suppkey % 2 + 1)::VARCHAR AS ta, list_sort(['P-' || (s_suppkey % 30)::VARCHAR, 'P-' || (s_suppkey % 40)::VARCHAR]) AS pr, s_suppkey % 10 = 9 AS oos,
  {_tok("'no cohort of type' || s_suppkey::VARCHAR || ' reads speech in town' || (s_suppkey % 7)::VARCHAR")} AS w, CASE WHEN s_suppkey % 2 = 0 THEN 'derived' ELSE 'curated' END AS ti FROM supplier, ki),
g AS (SELECT 'G-CAND-' || n_nationkey::VARCHAR AS id, n_nationkey AS n, a[n_nationkey % 3 + 1] AS ty, CASE WHEN n_nationkey % 3 = 0 THEN 'm' || (n_nationkey % 12)::VARCHAR END AS mo, 'T1' AS ta, list_sort(['P-' || (n_nationkey + 4)::VARCHAR, 'P-' || n_nationkey::VARCHAR]) AS pr, {_tok("'no cohort reads speech in town' || (n_nationkey % 7)::VARCHAR")} AS w, CASE WHEN n_nationkey % 2 = 0 THEN 'derived' ELSE 'curated' END AS ti FROM nation, ki),
m AS (SELECT c.*, CASE WHEN oos THEN NULL WHEN ty = 'structural_absence' THEN (SELECT arg_min(id, n) FROM g WHERE g.ty = c.ty AND g.mo = c.mo AND g.ta = c.ta) WHEN ty = 'combinatorial' THEN (SELECT arg_min(id, n) FROM g WHERE g.ty = c.ty AND g.pr = c.pr)
  ELSE (SELECT arg_max(id, struct_pack(s := len(list_intersect(g.w, c.w))::DOUBLE / len(list_distinct(g.w || c.w)), n := -n)) FROM g WHERE g.ti = c.ti AND len(list_intersect(g.w, c.w))::DOUBLE / len(list_distinct(g.w || c.w)) >= 0.35) END AS match,
  pr[1] = pr[2] AND substr(pr[1], 3)::INT < 25 AS con, CASE ty WHEN 'structural_absence' THEN ty || '|' || mo || '|' || ta WHEN 'combinatorial' THEN array_to_string(pr, '|') END AS key FROM c),
f AS (SELECT *, CASE WHEN key IS NOT NULL THEN min("order") FILTER (NOT oos AND match IS NULL AND NOT con) OVER (PARTITION BY key) END AS first FROM m),
o AS (SELECT *, CASE WHEN oos THEN 'out of scope' WHEN match IS NOT NULL THEN 'merged' WHEN con THEN 'conflict' WHEN first < "order" THEN 'merged into new' ELSE 'new' END AS outcome FROM f)
SELECT "order", outcome, match, CASE WHEN outcome = 'new' THEN 'G-CAND-' || (24 + row_number() OVER (PARTITION BY outcome ORDER BY "order"))::VARCHAR END AS id FROM o""",
}
