"""Text and coded-field functions over the driver's tables and the derived registry, every function called as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coded, metrics, missing, text
from ..operators import extraction
from .reports import _t
from .world import ctes, world

#: Texts made of every order, in the spellings that the normalisers must understand; read by both engines.
SHAPES = """
SELECT o_orderkey AS k,
  CASE o_orderkey % 5 WHEN 0 THEN 'https://doi.org/10.1016/j.abc.' || CAST(o_orderkey AS STRING) || 'Abstract' WHEN 1 THEN 'doi: 10.1000/XYZ-' || CAST(o_orderkey AS STRING) || 'keywords:' WHEN 2 THEN '  10.3390/' || CAST(o_orderkey AS STRING) || 'pageios. ' WHEN 3 THEN 'dx.doi.org/10.5/ab' ELSE 'no identifier' END AS doi,
  CASE o_orderkey % 6 WHEN 0 THEN '  Cortical thickness in ' || o_orderpriority || ' ' || CAST(o_orderkey AS STRING) WHEN 1 THEN '1-s2.0-S0000000000' || CAST(o_orderkey AS STRING) || '-main.pdf' WHEN 2 THEN '[STUB - excluded] a long enough title' WHEN 3 THEN 'Short one' WHEN 4 THEN 'Not reported in this long document' ELSE 'Speech, language and MCI: C1 T2 A3 V4 of ' || o_orderpriority END AS title,
  CASE o_orderkey % 4 WHEN 0 THEN '/data/in/1-s2.0-S' || CAST(o_orderkey AS STRING) || 'X-main.pdf' WHEN 1 THEN 'in/PMID_' || CAST(o_orderkey AS STRING) || '_title.pdf' WHEN 2 THEN 'folder/' ELSE 'other ' || o_orderpriority || '.pdf' END AS path,
  'Patients  with ' || o_orderpriority || CASE o_orderkey % 3 WHEN 0 THEN '; the MCI-group (n=' || CAST(o_orderkey % 90 AS STRING) || ') was seen.  No change was found' WHEN 1 THEN ' were not seen, and the fMRI data were lost' ELSE ' 12 p-tau217 assays; cross-sectional data' END || ' at visit ' || CAST(o_orderkey % 12 AS STRING) || '.' AS prose,
  CASE o_orderkey % 4 WHEN 0 THEN 'ok text □□' WHEN 1 THEN '' WHEN 2 THEN 'ok' ELSE '■x' END AS extract,
  CASE o_orderkey % 6 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' no ' WHEN 2 THEN '1' WHEN 3 THEN 'perhaps' WHEN 4 THEN '0' END AS flag,
  CAST(o_orderkey % 240 AS DOUBLE) / 2 AS share, o_orderkey % 7 AS part, o_orderkey % 5 AS whole
FROM {orders}"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SHAPES, orders=_t(spark, sf_dir, "orders"))


def q_text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = shapes(spark, sf_dir)
    return d.select(
        "k", text.norm_text(F.col("title")).alias("lowered"), text.norm_title(F.col("title")).alias("title"), text.norm_doi(F.col("doi")).alias("doi"), text.is_doi(text.norm_doi(F.col("doi"))).alias("is_doi"),
        text.plausible_title(F.col("title")).alias("plausible"), text.publisher_id(F.col("path")).alias("publisher_id"), text.basename(F.col("path")).alias("basename"),
        text.compact(F.col("prose")).alias("compact"), text.truncate_at_word(F.col("prose"), 30).alias("cut"), text.first_words(F.col("prose"), 4).alias("head"), text.safe_words(F.col("prose"), 5).alias("safe"), text.subscripts(F.col("title")).alias("subscripts"),
        text.corruption(F.col("extract")).alias("corruption"), coded.yes_no(F.col("flag")).alias("yes_no"), coded.truthy(F.col("flag")).alias("truthy"), coded.proportion(F.col("share")).alias("proportion"), coded.percent(F.col("part"), F.col("whole")).alias("percent"),
    )


def q_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of titles and prose without stop words, and their Jaccard similarity."""
    d = shapes(spark, sf_dir).select("k", text.tokens(F.col("title")).alias("a"), text.tokens(F.col("prose")).alias("b"))
    return d.select("k", F.array_join(F.array_sort("a"), ",").alias("a"), F.array_join(F.array_sort("b"), ",").alias("b"), F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("both"), F.size(F.array_union("a", "b")).alias("n_any"), text.jaccard(F.col("a"), F.col("b")).alias("similarity"))


def q_registry_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed codes of every registry row that is neither a copy nor out of scope."""
    d = coded.derived(coded.included(world(spark, sf_dir, "registry")))
    return d.select(
        "Paper_ID", coded.paper_number(F.col("Paper_ID")).alias("number"), "tier", "task", "year", coded.year_bucket(F.col("year")).alias("bucket"), "domain", "sample_n", "design", "arch", "has_xai",
        *[F.array_join(coded.categories(F.col("Category"), p), "|").alias(p) for p in ("comma", "slash", "codes")], missing.present(F.col("task_substage"), "gate").alias("substage"), coded.leading_code(F.col("Architecture_Family"), "A", "1-8").alias("arch_code"),
    )


def q_modality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, family, sub-type bucket and data-set family of every registry row."""
    d = world(spark, sf_dir, "registry")
    m, a = F.col("Modality"), F.col("Method_Architecture")
    return d.select("Paper_ID", F.array_join(F.array_sort(metrics.modality_nodes(m)), ",").alias("nodes"), metrics.modality_family(m, a).alias("family"), metrics.subtype_bucket(F.col("modality_subtype")).alias("subtype"), metrics.dataset_family(F.col("Dataset")).alias("dataset"))


def q_best_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric and value of every registry row's text, and whether they are suspect by either rule."""
    d = world(spark, sf_dir, "registry").withColumn("m", metrics.metric_parse(F.col("Best_Metric")))
    d = d.withColumn("best", metrics.discrimination(F.col("Best_Metric")))
    return d.select("Paper_ID", F.col("m.mtype").alias("mtype"), F.round("m.value", 6).alias("value"), metrics.suspect(F.col("m")).alias("suspect"), F.round("best", 6).alias("best"), metrics.suspect_internal(F.col("best"), F.col("Validation_Type")).alias("suspect_internal"))


def q_gap_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = world(spark, sf_dir, "gaps")
    return g.groupBy(metrics.gap_tier(F.col("tier"), F.col("gap_type"), F.col("id"), F.col("gap_statement")).alias("tier")).agg(F.count("*").alias("n"))


def q_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts made of orders, screened by phrase and confidence; category by its words."""
    words = {"C1": ("visit", "assay"), "C2": ("fmri", "lost", "seen"), "C3": ("tau", "assays", "cross")}
    d = shapes(spark, sf_dir).withColumn("abstract", F.concat_ws(" ", "prose", F.when(F.col("k") % 4 == 1, "in a Mouse Model of a case report").when(F.col("k") % 4 == 2, "an editorial"))).withColumn("confidence", F.when(F.col("k") % 3 > 0, (F.col("k") % 10) / 10.0))
    out = extraction.screen(d, "abstract", "confidence")
    return out.select("k", "reason", "route", extraction.best_category(F.col("abstract"), words).alias("category"))


QUERIES = {f.__name__: f for f in (q_text_scalars, q_token_sets, q_registry_derived, q_modality_labels, q_best_metric, q_gap_tier, q_screening)}

_S = "WITH s AS (" + SHAPES.format(orders="orders") + ")"
_FURN = "(abstract|keywords?:?|ios|page|ageing|jpad|brain|key)$"
_DOI = "rtrim(trim(doi), '.')"
_D1 = f"lower(regexp_replace(regexp_replace({_DOI}, '^(?i)(?:https?://)?(?:dx\\.)?doi\\.org/', ''), '^(?i)doi:\\s*', ''))"
_D3 = f"rtrim(regexp_replace(rtrim(regexp_replace({_D1}, '{_FURN}', ''), ':/-'), '{_FURN}', ''), ':/-')"
_COMPACT = "trim(regexp_replace(prose, '\\s+', ' ', 'g'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


def _tok(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z][a-z0-9\\-]{{2,}}')), lambda w: NOT list_contains({_STOP}, w))"


def _sub(x: str) -> str:
    for digit, sign in zip("0123456789", "₀₁₂₃₄₅₆₇₈₉", strict=True):
        x = f"regexp_replace({x}, '\\b([CTAV]){digit}\\b', '\\1{sign}', 'g')"
    return x


_SCOPE = "trim(coalesce(duplicate_of, '')) IN ('', 'not reported') AND NOT regexp_matches(lower(Modality), 'out[-_]of[-_]scope')"
_N = r"'^\s*\**\s*(?:[Nn]\s*=\s*)?[~≈]?\s*(\d+(?:\.\d+)?)\s*(\S*)'"


def _nodes(x: str) -> str:
    each = ", ".join(f"CASE WHEN {' OR '.join(f'contains({x}, {w!r})' for w in ws)} THEN '{n}' END" for n, ws in metrics.NODES.items())
    return f"list_sort(list_filter([{each}], lambda v: v IS NOT NULL))"


def _ladder(x: str, table, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({x}, {w!r})' for w in ws)} THEN '{n}'" for n, ws in table) + f" ELSE {other} END"


_SUBHITS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(st, '{p}') THEN '{n}' END" for n, p in metrics.SUBTYPES) + "], lambda v: v IS NOT NULL)"

SQL = {
    "q_text_scalars": _S + f"""
SELECT k, lower(trim(title)) AS lowered, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS title, {_D3} AS doi, regexp_matches({_D3}, '^10\\.\\d{{4,9}}/.{{3,}}$') AS is_doi,
  CASE WHEN length(trim(title)) >= 20 AND NOT regexp_matches(trim(title), '(?i)\\.pdf$|^pmid_|^1-s2\\.0-|^\\[stub|^not reported|^\\[non-research') THEN trim(title) END AS plausible,
  CASE WHEN regexp_matches(base, '^1-s2\\.0-S[0-9A-Za-z]+-main\\.pdf$') THEN 'PII:' || regexp_extract(base, '^1-s2\\.0-(S[0-9A-Za-z]+)-main\\.pdf$', 1) WHEN regexp_matches(base, '^PMID_\\d+_') THEN 'PMID:' || regexp_extract(base, '^PMID_(\\d+)_', 1) END AS publisher_id, nullif(base, '') AS basename,
  {_COMPACT} AS compact, CASE WHEN length({_COMPACT}) <= 30 THEN {_COMPACT} ELSE regexp_replace(regexp_replace(substr({_COMPACT}, 1, 30), '\\s+\\S*$', ''), '[ ,;:\\-]+$', '') END AS cut, array_to_string(string_split({_COMPACT}, ' ')[1:4], ' ') AS head, array_to_string(regexp_extract_all(prose, '[A-Za-z0-9\\-]+')[1:5], ' ') AS safe, {_sub('title')} AS subscripts,
  CASE WHEN length(extract) > 0 THEN (length(extract) - length(translate(extract, '�■□', '')))::DOUBLE / length(extract) END AS corruption,
  CASE WHEN lower(trim(flag)) IN ('true', 'yes', '1') THEN 'Yes' WHEN lower(trim(flag)) IN ('false', 'no', '0') THEN 'No' ELSE 'NR' END AS yes_no, CASE WHEN lower(trim(flag)) IN ('true', 'yes', '1') THEN true WHEN lower(trim(flag)) IN ('false', 'no', '0') THEN false END AS truthy,
  CASE WHEN (CASE WHEN share > 1.5 THEN share / 100 ELSE share END) BETWEEN 0 AND 1 THEN CASE WHEN share > 1.5 THEN share / 100 ELSE share END END AS proportion, CASE WHEN whole <> 0 THEN 100.0::DOUBLE * part / whole END AS percent
FROM (SELECT *, string_split(path, '/')[-1] AS base FROM s)""",
    "q_token_sets": _S + f"""
SELECT k, array_to_string(list_sort(a), ',') AS a, array_to_string(list_sort(b), ',') AS b, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, len(list_distinct(a || b))::INT AS n_any,
  CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / greatest(1, len(list_distinct(a || b))) END AS similarity FROM (SELECT k, {_tok('title')} AS a, {_tok('prose')} AS b FROM s)""",
    "q_registry_derived": ctes("registry") + f""",
r AS (SELECT *, regexp_replace(trim(Sample_N_Approx), ',', '', 'g') AS n, try_cast(nullif(regexp_extract(Publication_Year, '(\\d{{4}})', 1), '') AS INT) AS y FROM registry WHERE {_SCOPE})
SELECT Paper_ID, regexp_extract(Paper_ID, '^P-(\\d+)$', 1)::INT AS number, coalesce(nullif(regexp_extract(trim(Validation_Type), '^(V[1-4])', 1), ''), 'NR') AS tier, coalesce(nullif(regexp_extract(trim(Task_Type), '^(T[1-6])', 1), ''), 'NR') AS task, y AS year,
  CASE WHEN y IS NULL THEN 'undated' WHEN y < 2021 THEN 'early' ELSE y::VARCHAR END AS bucket, CASE WHEN upper(trim(Category)) IN ('C1', 'C2', 'C3', 'C4', 'C5', 'C6') THEN upper(trim(Category)) ELSE 'OTHER' END AS domain,
  CASE WHEN NOT regexp_matches(regexp_extract(n, {_N}, 2), '(?i)^(?:stud(?:y|ies)|papers?|articles?|publications?|trials?|rcts|records?|reviews|experts|datasets|cohorts)') AND try_cast(nullif(regexp_extract(n, {_N}, 1), '') AS DOUBLE) > 0 THEN try_cast(regexp_extract(n, {_N}, 1) AS DOUBLE) END AS sample_n,
  CASE WHEN starts_with(lower(trim(study_design_type)), 'longitudinal') THEN 'longitudinal' ELSE lower(trim(study_design_type)) END AS design, trim(Architecture_Family) AS arch, lower(trim(XAI_Method)) NOT IN ('', 'not reported', 'none', 'n/a', 'not applicable') AS has_xai,
  array_to_string(list_filter(list_transform(string_split(upper(Category), ','), lambda v: trim(v)), lambda v: v <> ''), '|') AS comma, array_to_string(list_filter(list_transform(string_split(upper(Category), '/'), lambda v: trim(v)), lambda v: v <> ''), '|') AS slash,
  array_to_string(regexp_extract_all(upper(Category), '\\bC[1-6]\\b'), '|') AS codes, CASE WHEN trim(task_substage) NOT IN ('', 'Not reported', 'Not Reported', 'not reported', 'NR', 'N/A') THEN task_substage END AS substage,
  nullif(regexp_extract(trim(Architecture_Family), '^(A[1-8])', 1), '') AS arch_code
FROM r""",
    "q_modality_labels": ctes("registry") + f""",
r AS (SELECT *, lower(trim(Modality)) AS mt, lower(trim(Modality || ' ' || Method_Architecture)) AS ft, regexp_replace(lower(trim(modality_subtype)), '[_\\-]+', ' ', 'g') AS st, upper(Dataset) AS ds FROM registry)
SELECT Paper_ID, array_to_string({_nodes('mt')}, ',') AS nodes, {_ladder('ft', metrics.FAMILIES, f'coalesce({_nodes("mt")}[1], ft)')} AS family,
  CASE WHEN lower(trim(modality_subtype)) IN ('', 'not reported', 'not_reported', 'nr', 'unknown', 'none') THEN '' WHEN regexp_matches(st, '\\b(?:multimodal|trimodal)\\b') OR len({_SUBHITS}) > 1 THEN 'multimodal' ELSE coalesce({_SUBHITS}[1], '') END AS subtype,
  {_ladder('ds', metrics.DATASETS, 'CASE ' + ' '.join(f"WHEN contains(ds, '{c}') THEN 'single-centre-{c.strip().lower()}'" for c in metrics.COUNTRIES) + " ELSE 'single-centre' END")} AS dataset
FROM r""",
    "q_best_metric": ctes("registry") + r""",
n AS (SELECT Paper_ID, Validation_Type, Best_Metric, regexp_extract_all(Best_Metric, '\d+(?:\.\d+)?') AS x FROM registry),
v AS (SELECT *, CASE WHEN starts_with(Best_Metric, 'AUC 0.') THEN 'AUC' WHEN starts_with(Best_Metric, 'accuracy') THEN 'ACC' WHEN starts_with(Best_Metric, 'no accuracy') THEN 'HR' WHEN starts_with(Best_Metric, 'F1') THEN 'F1' WHEN contains(Best_Metric, ' AUC (95%') THEN 'AUC' END AS mtype,
  CASE WHEN starts_with(Best_Metric, 'AUC 0.') THEN x[1]::DOUBLE WHEN starts_with(Best_Metric, 'accuracy') THEN x[1]::DOUBLE / 100 WHEN starts_with(Best_Metric, 'no accuracy') THEN x[1]::DOUBLE WHEN starts_with(Best_Metric, 'F1') THEN x[2]::DOUBLE WHEN contains(Best_Metric, ' AUC (95%') THEN 0.95 END AS value,
  CASE WHEN starts_with(Best_Metric, 'AUC 0.') THEN x[1]::DOUBLE WHEN starts_with(Best_Metric, 'accuracy') THEN x[1]::DOUBLE / 100 WHEN starts_with(Best_Metric, 'F1') THEN x[2]::DOUBLE WHEN contains(Best_Metric, ' AUC (95%') THEN x[1]::DOUBLE END AS best FROM n)
SELECT Paper_ID, mtype, round(value, 6) AS value, coalesce(mtype IN ('AUC', 'ACC', 'F1') AND value > 0.97, false) AS suspect, round(best, 6) AS best, coalesce(best >= 0.97, false) AND NOT starts_with(upper(trim(Validation_Type)), 'V4') AS suspect_internal FROM v""",
    "q_gap_tier": ctes("gaps") + """
SELECT CASE WHEN lower(trim(coalesce(tier, ''))) IN ('curated', 'derived', 'combinatorial', 'structural') THEN lower(trim(tier)) WHEN gap_type = 'combinatorial' THEN 'combinatorial' WHEN gap_type IN ('structural_absence', 'underrepresentation') THEN 'structural'
  WHEN gap_type = 'candidate' OR starts_with(lower(trim(gap_statement)), 'limitation-derived gap') OR starts_with(lower(id), 'g-cand') THEN 'derived' ELSE 'curated' END AS tier, count(*) AS n FROM gaps GROUP BY 1""",
    "q_screening": _S + f""",
a AS (SELECT k, lower(prose || CASE WHEN k % 4 = 1 THEN ' in a Mouse Model of a case report' WHEN k % 4 = 2 THEN ' an editorial' ELSE '' END) AS t, CASE WHEN k % 3 > 0 THEN (k % 10) / 10.0 END AS c FROM s),
b AS (SELECT *, CASE {' '.join(f"WHEN contains(t, '{p}') THEN '{p}'" for p in extraction.EXCLUSIONS)} END AS reason, contains(t, 'visit')::INT + contains(t, 'assay')::INT AS n1, contains(t, 'fmri')::INT + contains(t, 'lost')::INT + contains(t, 'seen')::INT AS n2, contains(t, 'tau')::INT + contains(t, 'assays')::INT + contains(t, 'cross')::INT AS n3 FROM a)
SELECT k, reason, CASE WHEN reason IS NOT NULL THEN 'excluded' WHEN c < 0.8 THEN 'borderline' ELSE 'kept' END AS route, CASE WHEN greatest(n1, n2, n3) = 0 THEN NULL WHEN n1 >= n2 AND n1 >= n3 THEN 'C1' WHEN n2 >= n3 THEN 'C2' ELSE 'C3' END AS category FROM b""",
}
