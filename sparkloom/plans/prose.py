"""Detectors over blocks of prose that are made of every order; the SQL reads the same texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect
from ..operators import extraction
from .reports import _t

PROSE = """
SELECT o_orderkey AS k, 'T' || CAST(o_orderkey % 6 + 1 AS STRING) AS task,
  CASE o_orderkey % 7 WHEN 0 THEN 'Letter to the Editor: on EEG' WHEN 1 THEN 'A randomised trial of walking' WHEN 2 THEN 'Editorials are many' WHEN 3 THEN 'Viewpoint' ELSE 'Deep networks for MRI' END AS title_line,
  CASE o_orderkey % 5 WHEN 0 THEN 'This commentary reads a paper on people free of Parkinson; adults were seen' WHEN 1 THEN 'A placebo-controlled trial in type 2 diabetes' WHEN 2 THEN 'Miners with COPD. Dialysis was excluded.' WHEN 3 THEN 'Individuals were excluded if they had heart failure. They had chronic pain' ELSE 'Older adults' END AS opening,
  CASE o_orderkey % 4 WHEN 0 THEN 'No survival analysis was done' WHEN 1 THEN 'Cox regression gave the hazard ratio' WHEN 2 THEN 'We could not predict future decline' ELSE 'Three visits' || chr(10) || 'without time points of MRI and PET' END || '. '
    || CASE o_orderkey % 6 WHEN 0 THEN 'A longitudinal cohort of sMCI was followed over 3.5 years' WHEN 1 THEN 'People aged 70 years had follow-up within 2 years of age' WHEN 2 THEN 'EEG connectivity and accuracy were such as expected' WHEN 3 THEN 'The cross-sectional study read plasma and CSF biomarkers' WHEN 4 THEN 'Conversion of EMCI within 18 months' ELSE 'Speech prosody' || chr(10) || 'none with trajectory model' END || '. '
    || CASE o_orderkey % 9 WHEN 0 THEN 'This is a systematic review of transcripts' WHEN 1 THEN 'The AUC would be low' WHEN 2 THEN 'Balanced accuracy and F1 are given' WHEN 3 THEN 'SKIPPED by Agent 3' WHEN 4 THEN 'The odds ratio was 2' WHEN 5 THEN 'Follow-up after two years' WHEN 6 THEN 'Duplicate of paper ' || CAST(o_orderkey % 90 AS STRING) ELSE 'Retinal images of SCD before MCI' END || '.' AS body,
  CASE o_orderkey % 11 WHEN 0 THEN 'NR. The paper reports none' WHEN 1 THEN '0.' || CAST(o_orderkey % 90 + 10 AS STRING) || ' Acc' WHEN 2 THEN 'AUC 0.8.' WHEN 3 THEN 'The paper reports no accuracy of any kind' WHEN 4 THEN CAST(o_orderkey % 120 AS STRING) || '%' WHEN 5 THEN '20 months to conversion' WHEN 6 THEN '' WHEN 7 THEN 'hedges g 0.4' WHEN 8 THEN 'no hazard ratio reported' WHEN 9 THEN '87 % auc' ELSE 'standardised mean difference 1.2' END AS best,
  CASE o_orderkey % 9 WHEN 0 THEN 'C2 = EEG (resting, eyes closed), recorded at rest' WHEN 1 THEN '(Neuroimaging (MRI/PET)) - Structural MRI (T1, 3T) volumetry. The codebook says so' WHEN 2 THEN 'The codebook names MRI' WHEN 3 THEN 'Modality: gait sensors; worn at home' WHEN 4 THEN 'not reported' WHEN 5 THEN 'A procedural document' WHEN 6 THEN 'Plasma p-tau 217 - measured by assay, twice' WHEN 7 THEN '**this assignment** follows' ELSE 'Fundus photographs' END AS modality,
  CASE o_orderkey % 4 WHEN 0 THEN 'Assigned' WHEN 1 THEN 'Category assigned' WHEN 2 THEN 'note' ELSE 'Category' END || CASE o_orderkey % 3 WHEN 0 THEN ': C' ELSE ' = V' END || CAST(o_orderkey % 6 + 1 AS STRING) || ' - the stream.' AS section,
  CASE o_orderkey % 6 WHEN 0 THEN 'Contents lists available at ScienceDirect. We propose a novel network for conversion in older adults seen at many sites over ten and more years. End.' WHEN 1 THEN 'Background first. In this study we read speech.' WHEN 2 THEN '' WHEN 3 THEN 'Original article' || chr(10) || 'Cortical thickness predicts conversion in adults' || chr(10) || 'Objective of it' WHEN 4 THEN 'Short. Words without any cue at all, but long enough.' ELSE 'Methods: limitation and future work' END AS evidence,
  CASE o_orderkey % 3 WHEN 0 THEN 'a novel fusion' WHEN 1 THEN '' ELSE 'Contents lists available' END AS answer,
  CASE o_orderkey % 5 WHEN 0 THEN 'Published online 12 May ' || CAST(1990 + o_orderkey % 30 AS STRING) WHEN 1 THEN '© 20' || CAST(10 + o_orderkey % 10 AS STRING) || ' the authors, 1999' WHEN 2 THEN 'seen in (2003) and 2015' WHEN 3 THEN 'from 1975 to 2011 and 2031' ELSE 'no date' END AS dated
FROM {orders}"""


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PROSE, orders=_t(spark, sf_dir, "orders"))


def q_design_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = prose(spark, sf_dir)
    return d.select("k", detect.study_design(F.col("body"), F.col("opening"), F.col("title_line")).alias("design"), detect.instrument(detect.study_design(F.col("body"), F.col("opening"), F.col("title_line"))).alias("instrument"))


def q_block_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = prose(spark, sf_dir)
    b = F.col("body")
    return d.select(
        "k", detect.task_substage(b, F.col("task")).alias("substage"), detect.population(F.col("opening")).alias("population"), detect.modality_subtype(b).alias("subtype"), detect.prediction_horizon(b, F.col("task")).alias("horizon"),
        detect.metric_type(F.col("best"), b).alias("metric_type"), detect.skip_reason(F.concat(F.lit("## Paper 1: "), F.col("title_line"), F.lit("\n"), b)).alias("skip"), detect.scaffold(F.col("section")).alias("scaffold"),
        extraction.detect(b, [("cox", "(?i)cox"), ("speech", "(?i)speech"), ("eeg", "(?i)eeg")]).alias("rule"),
    )


def q_declared_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = prose(spark, sf_dir)
    return d.select(
        "k", detect.canonical_metric(F.col("best")).alias("metric"), detect.not_reported(F.col("best")).alias("absent"), detect.denies_metric(F.col("best")).alias("denied"), detect.bare_proportion(F.col("best")).alias("bare"),
        detect.modality_label(F.col("modality")).alias("label"), detect.category_label(F.concat(F.lit("C"), (F.col("k") % 8).cast("string"))).alias("category"),
        extraction.without_code(F.concat(F.lit("V"), (F.col("k") % 4 + 1).cast("string"), F.lit(": k-fold"))).alias("plain"), extraction.unique_declared(F.concat_ws(" ", "section", "body"), r"(?i)\b(?:Assigned|Category)\s*[:=]\s*([CV]\d)").alias("unique"),
        extraction.duplicate_of(F.col("body")).alias("copy_of"), extraction.first_year(F.col("dated"), 2026).alias("year"), extraction.declared_value(F.col("section")).alias("declared"), detect.strip_label(F.col("section")).alias("stripped"),
        detect.strip_code_prefix(F.concat(F.lit("C"), (F.col("k") % 8 + 1).cast("string"), F.lit(" ("), F.col("modality"), F.lit(" (x)) - "), F.col("opening"))).alias("unprefixed"), extraction.leading_declared(F.col("section"), "C").alias("code"),
        detect.canonical_design(F.col("title_line")).alias("design"), detect.canonical_metric_type(F.element_at(F.split("best", " "), -1)).alias("type"), detect.xai_declared(F.concat(F.lit("XAI method is "), F.when(F.col("k") % 3 == 0, "Shapley").otherwise("none"), F.lit(". "), F.when(F.col("k") % 4 == 0, "XAI_Method: LIME.").otherwise(""))).alias("xai"),
        detect.sample_size_prose(F.concat(F.lit("A cohort of "), (F.col("k") % 300).cast("string"), F.when(F.col("k") % 2 == 0, " older adults").otherwise(" years, (n = 41)"))).alias("size"),
    )


def q_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = prose(spark, sf_dir)
    return d.select("k", detect.novelty(F.col("answer"), F.col("evidence")).alias("novelty"), detect.excerpt(F.col("evidence"), ("limitation", "conversion", "speech")).alias("excerpt"), detect.page_title(F.col("evidence")).alias("title"))


def q_auc_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels beside the AUC in a block against the row's task."""
    d = _t(spark, sf_dir, "orders").selectExpr("*", "o_orderkey AS k", AUC + " AS auc", AUC_BLOCK + " AS block", "'T' || CAST(o_orderkey % 4 + 1 AS STRING) AS task")
    return d.select("k", detect.auc_provenance(F.col("auc"), F.col("task"), F.col("block")).alias("flag"))


AUC = "'0.' || CAST(70 + o_orderkey % 3 AS STRING)"
AUC_BLOCK = """'first line without' || chr(10) || '- AUC 0.70 for MCI versus controls; ' || CASE o_orderkey % 5 WHEN 0 THEN 'AUC 0.71 for conversion to AD' WHEN 1 THEN 'the AUC of NC to MCI was 0.72' WHEN 2 THEN 'AUC 0.70' WHEN 3 THEN 'AUCs of detection of MCI from controls: 0.71' ELSE 'AUC 0.72, conversion-classification' END"""


def q_candidate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = prose(spark, sf_dir)
    insight = F.concat(F.lit("P-1 finds "), F.substring("body", 1, 70), F.when(F.col("k") % 3 == 0, " whereas P-2 finds more").otherwise(" and the"))
    flags = detect.quality_flags(insight, F.when(F.col("k") % 4 == 0, "Evaluate fused models").otherwise("Screening"), F.substring("body", 1, 50), F.concat(F.lit("Results 1 2 3 "), F.col("section")), F.lit("P-2"))
    scope = detect.out_of_scope(F.col("opening"), F.when(F.col("k") % 5 == 0, "needs an RCT of a drug by ICD"))
    rejected = detect.rejected_papers([F.concat(F.lit("P-7 was kept. P-3 rejected; P-"), (F.col("k") % 50).cast("string"), F.lit(" dropped. Held: P-9")), F.col("body")], F.array(F.lit("P-9"), F.concat(F.lit("P-"), (F.col("k") % 3).cast("string"))))
    return d.select("k", F.array_join(flags, ",").alias("flags"), F.array_join(scope, ",").alias("scope"), F.array_join(rejected, ",").alias("rejected"), detect.short_modality(F.col("modality"), F.when(F.col("k") % 2 == 0, "structural_mri")).alias("short"), detect.clean_label(F.col("modality")).alias("clean"))


QUERIES = {f.__name__: f for f in (q_design_detect, q_block_detect, q_declared_values, q_excerpts, q_auc_provenance, q_candidate_flags)}


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _has(x: str, p: str) -> str:
    return f"regexp_matches({x}, {_q(p)})"


def _asserted(t: str, p: str) -> str:
    """Some line of some sentence has the pattern, and from there to the sentence's end there is no denial."""
    ls = "string_split(seg, chr(10))"
    return f"len(list_filter(string_split({t}, '. '), lambda seg: len(list_filter(range(1, len({ls}) + 1), lambda i: regexp_matches({ls}[i], {_q('(?i)' + p)}) AND NOT regexp_matches(array_to_string({ls}[i:], chr(10)), {_q(detect.DENIAL)}))) > 0)) > 0"


def _anyof(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(w)})" for w in words) + ")"


def _design() -> str:
    parts = {"block": "lower(body)", "opening": "lower(opening)", "title_line": "lower(title_line)"}
    out = []
    for name, where, denied, words in detect.DESIGNS:
        t = parts[where]
        alt = "|".join(words)
        cond = _asserted(t, alt) if denied else _has(t, rf"\b(?:{alt})\b") if where == "title_line" else _anyof(t, words)
        out.append(f"WHEN {cond} THEN '{name}'")
    return "CASE " + " ".join(out) + f" WHEN {_has('lower(body)', detect.FOLLOW_UP)} AND {_asserted('lower(body)', 'follow-up|follow up')} THEN 'longitudinal_2point' ELSE 'cross_sectional' END"


def _horizon() -> str:
    tries = []
    for p, per in detect.HORIZONS:
        m = f"regexp_extract(low, {_q('(?s)' + p)}, 0)"
        at = f"strpos(low, {m})"
        v = f"try_cast(nullif(regexp_extract(low, {_q('(?s)' + p)}, 1), '') AS DOUBLE)"
        v = f"round({v} / 12, 1)" if per > 1 else v
        around = f"substr(low, greatest(1, {at} - 60)::BIGINT, ({at} - greatest(1, {at} - 60) + length({m}) + 20)::BIGINT)"
        tries.append(f"CASE WHEN {m} <> '' AND NOT {_has(around, detect.AGE)} AND {v} BETWEEN 0.1 AND 20 THEN {v} END")
    return f"CASE WHEN task IN ('T2', 'T5') THEN coalesce({', '.join(tries)}) END"


def _metric_type() -> str:
    b, low = "lower(trim(best))", "lower(body)"
    own = " ".join(f"WHEN {_has(b, '^(?:' + p + ')')} THEN '{n}'" for n, p in detect.METRIC_STARTS) + " " + " ".join(f"WHEN {_asserted(b, p)} THEN '{n}'" for n, p in detect.METRIC_WORDS)
    text = " ".join(f"WHEN {_asserted(low, p)} THEN '{n}'" for n, p in detect.PROSE_METRICS)
    return f"CASE WHEN {b} = '' THEN CASE {text} ELSE 'not reported' END WHEN {_ABSENT} THEN 'not reported' ELSE CASE {own} ELSE 'not reported' END END"


_BEST = "trim(regexp_replace(best, '\\s+', ' ', 'g'))"
_ABSENT = f"(lower({_BEST}) IN ('', 'nr', 'n/a', 'none') OR {_has(f'lower({_BEST})', '^(?:nr|n/a|none)\\b\\s*[.:;,-]')} OR starts_with(lower({_BEST}), 'not reported') OR starts_with(lower({_BEST}), 'not applicable'))"
_DENIED = _has(_BEST, r"(?i)^(?:the\s+\w+\s+)?(?:paper|study|article|extract|authors)?\s*(?:reports?|computes?|contains?|provides?)?\s*no\s+(?:classification|discrimination|diagnostic|predictive|performance)?\s*(?:metric|accuracy|auc|statistic)")
_NAMES = "|".join(detect.METRIC_NAMES)
_B2 = f"regexp_replace({_BEST}, '\\.+$', '')"
_TURN = rf"(?i)^([0-9][0-9.,]*\s*%?)\s+({_NAMES})\b"
_CANON = "CASE lower(regexp_extract({0}, {1}, 2)) ".format(_B2, _q(_TURN)) + " ".join(f"WHEN '{n.lower()}' THEN '{n}'" for n in reversed(dict.fromkeys(detect.METRIC_NAMES))) + " END"
_PAR = r"\((?:[^()]|\([^()]*\))*\)"
_M1 = "regexp_replace(regexp_replace(trim(regexp_replace(modality, '\\s+', ' ', 'g')), '^[*_ ]+|[*_ ]+$', '', 'g'), '^(?i)(?:verbatim gloss|category|modality|assigned|why c\\d)\\s*[:=]\\s*', '')"
_M2 = f"regexp_replace(trim(regexp_replace({_M1}, '^C[1-6]\\s*(?:=|-|–|—|:)?\\s*', '')), {_q('^' + _PAR + r'[\s\-–—:;,.=]*')}, '')"
_CUTS = [rf"^((?:{_PAR}|[^()]){{7,}}?[a-z0-9)\"])[.;](?:\s|$)", rf"^((?:{_PAR}|[^()]){{8,}}?)\s[-–—]\s", rf"^((?:{_PAR}|[^()]){{8,}}?),\s"]
_CLAUSE = "coalesce(list_sort(list_filter([" + ", ".join(f"regexp_extract(m, {_q(c)}, 1)" for c in _CUTS) + "], lambda v: v <> ''), 'ASC')[1], m)"
_SENT = "list_filter(regexp_split_to_array(regexp_replace(trim(regexp_replace(evidence, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda v: v <> '')"
METRIC_SQL = f"""CASE WHEN {_B2} = '' THEN 'not reported' WHEN {_ABSENT} OR {_DENIED} OR upper({_B2}) IN ('NR', 'NONE') THEN 'NR' WHEN {_has(_B2, f'(?i)^(?:{_NAMES})')} THEN {_B2} WHEN {_has(_B2, _TURN)} THEN {_CANON} || ' ' || trim(regexp_extract({_B2}, {_q(_TURN)}, 1)) ELSE {_B2} END"""
LABEL_SQL = f"""CASE WHEN lower(modality) = 'not reported' THEN NULL WHEN {_has('modality', detect.NO_DATA)} THEN 'none (no primary data)' WHEN m <> '' AND length(trim({_CLAUSE})) BETWEEN 3 AND 80 AND NOT {_has(f'trim({_CLAUSE})', detect.JUSTIFIES)} AND NOT {_has(f'trim({_CLAUSE})', r'(?i)\*\*|\bcodebook\b|\bassignment\b')} THEN trim({_CLAUSE}) END"""
CONVERSION_SQL = f"""CASE WHEN {_anyof('low', ("pmci", "progressive mci", "stable mci", "smci", "p-mci", "s-mci"))} THEN 'pMCI_vs_sMCI' WHEN contains(low, 'emci') AND {_anyof('low', ("conversion", " to ad"))} THEN 'EMCI_to_AD' WHEN contains(low, 'scd') AND {_anyof('low', ("mci", "progression"))} THEN 'SCD_to_MCI' ELSE 'MCI_to_AD' END"""
POPULATION_SQL = f"""CASE {' '.join(f"WHEN {_anyof('own', w)} THEN '{n}'" for n, w in detect.POPULATIONS)} ELSE 'general' END"""
_LAST = "lower(rtrim(string_split(best, ' ')[-1], '.'))"
_TYPES = f"CASE WHEN {_LAST} = '' THEN NULL WHEN {_LAST} IN ('none', 'nr') THEN 'not reported' WHEN {_LAST} = 'auc' THEN 'AUC_ROC' WHEN {_LAST} = 'acc' THEN 'Acc' WHEN regexp_matches({_LAST}, '^[a-z][a-z0-9_]{{2,60}}$') THEN rtrim(string_split(best, ' ')[-1], '.') END"
_S = "WITH p AS (" + PROSE.format(orders="orders") + ")"


def _lowany(words) -> str:
    return _anyof("lower(v)", words)


_USABLE = f"NOT {_lowany(detect.NO_NOVELTY)} AND NOT ({_lowany(detect.PAGE_HEAD)} AND NOT {_lowany(('study', 'propose', 'model', 'framework', 'method'))}) AND {_has('lower(v)', detect.NOVELTY_CUES)}"


def _excerpt() -> str:
    cut = "substr(trim(regexp_replace(substr(evidence, {0}, 700), '\\s+', ' ', 'g')), 1, 450)"
    return "CASE WHEN evidence = '' THEN 'not reported' " + " ".join(f"WHEN contains(lower(evidence), '{w}') THEN {cut.format(f'''strpos(lower(evidence), '{w}')''')}" for w in ("limitation", "conversion", "speech")) + f" ELSE {cut.format(1)} END"


SQL = {
    "q_design_detect": _S + f", d AS (SELECT k, {_design()} AS design FROM p) SELECT k, design, CASE " + " ".join(f"WHEN {_has('design', pat)} THEN '{n}'" for n, pat in detect.INSTRUMENTS) + " ELSE 'not assigned (design not coded)' END AS instrument FROM d",
    "q_block_detect": _S + f""", l AS (SELECT *, lower(body) AS low, regexp_replace(lower(opening), {_q(detect.EXCLUSION)}, ' ', 'g') AS own FROM p)
SELECT k, CASE task WHEN 'T2' THEN {CONVERSION_SQL}
    WHEN 'T5' THEN 'MCI_reversion' WHEN 'T1' THEN 'MCI_vs_HC' WHEN 'T3' THEN 'multiclass_staging' WHEN 'T4' THEN 'biomarker_correlation' ELSE 'not reported' END AS substage,
  CASE {' '.join(f"WHEN {_anyof('own', w)} THEN '{n}'" for n, w in detect.POPULATIONS)} ELSE 'general' END AS population,
  CASE {' '.join(f"WHEN {' AND '.join(_has('low', x) for x in ps)} THEN '{n}'" for n, ps in detect.SUBTYPE_RULES)} ELSE 'not reported' END AS subtype, {_horizon()} AS horizon, {_metric_type()} AS metric_type,
  CASE WHEN {_has("'## Paper 1: ' || title_line", r'(?i)^##\s*Paper\s*[^:\n]+:\s*(?:\[|Corrigendum\b)')} THEN title_line WHEN {_has('body', r'(?is)SKIP(?:PED)?\b.{0,60}Agent\s*3|agents\s*\(3')} THEN 'block instructs downstream agents to skip' END AS skip,
  {_has('section', detect.SCAFFOLD)} OR len(regexp_extract_all(section, '[A-Za-z]+')) < 5 AS scaffold,
  CASE WHEN len(list_filter(s, lambda v: regexp_matches(v, '(?i)cox') AND NOT regexp_matches(v, '(?i)\\b(?:no|not|without|lack|lacks|absent|never)\\b'))) > 0 THEN 'cox' WHEN len(list_filter(s, lambda v: regexp_matches(v, '(?i)speech') AND NOT regexp_matches(v, '(?i)\\b(?:no|not|without|lack|lacks|absent|never)\\b'))) > 0 THEN 'speech'
    WHEN len(list_filter(s, lambda v: regexp_matches(v, '(?i)eeg') AND NOT regexp_matches(v, '(?i)\\b(?:no|not|without|lack|lacks|absent|never)\\b'))) > 0 THEN 'eeg' END AS rule
FROM (SELECT *, string_split(regexp_replace(body, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM l)""",
    "q_declared_values": _S + f""", d AS (SELECT *, {_M2} AS m, list_distinct(list_transform(regexp_extract_all(section || ' ' || body, '(?i)\\b(?:Assigned|Category)\\s*[:=]\\s*([CV]\\d)', 1), lambda v: lower(v))) AS u FROM p)
SELECT k, {METRIC_SQL} AS metric,
  {_ABSENT} AS absent, {_DENIED} AS denied, coalesce(NOT regexp_matches(regexp_extract({_BEST}, '^(\\d+(?:\\.\\d+)?)\\s*(%?)\\s*(.*)$', 3), '^[A-Za-z]') AND CASE WHEN regexp_extract({_BEST}, '^(\\d+(?:\\.\\d+)?)\\s*(%?)\\s*(.*)$', 2) = '%' THEN try_cast(regexp_extract({_BEST}, '^(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) <= 100 ELSE try_cast(nullif(regexp_extract({_BEST}, '^(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) <= 1 END, false) AS bare,
  {LABEL_SQL} AS label,
  CASE k % 8 {' '.join(f"WHEN {c[1]} THEN '{v}'" for c, v in detect.CATEGORY_LABELS.items())} ELSE 'not reported' END AS category, 'k-fold' AS plain, CASE WHEN len(u) = 1 THEN u[1] END AS "unique",
  CASE WHEN k % 9 = 6 THEN 'P-' || (k % 90)::VARCHAR END AS copy_of, CASE k % 5 WHEN 0 THEN (1990 + k % 30)::INT WHEN 1 THEN (2010 + k % 10)::INT WHEN 2 THEN 2003 WHEN 3 THEN 2011 END AS year,
  CASE WHEN k % 4 <> 2 THEN nullif(rtrim(regexp_extract(section, '[:=]\\s*(.+)', 1), '.'), '') END AS declared, CASE WHEN k % 4 <> 2 THEN 'the stream.' ELSE section END AS stripped,
  CASE WHEN opening = '' THEN NULL ELSE upper(substr(opening, 1, 1)) || substr(opening, 2) END AS unprefixed, CASE WHEN k % 4 <> 2 AND k % 3 = 0 THEN 'C' || (k % 6 + 1)::VARCHAR END AS code,
  CASE title_line WHEN 'Viewpoint' THEN 'viewpoint' END AS design, {_TYPES} AS type, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 3 = 0 THEN 'SHAP' ELSE 'none' END AS xai, CASE WHEN k % 2 = 0 THEN (k % 300)::VARCHAR ELSE '41' END AS size
FROM d""",
    "q_excerpts": _S + f""", e AS (SELECT *, {_SENT} AS s, trim(regexp_replace(evidence, '\\s+', ' ', 'g')) AS clean FROM p),
f AS (SELECT *, coalesce(list_filter(s, lambda v: {_USABLE})[1], trim(regexp_replace(coalesce(list_filter(s, lambda v: NOT {_lowany(detect.PAGE_HEAD)} AND length(v) >= 30)[1], s[1], clean), '(?i)contents lists available.*$', ''))) AS found FROM e),
g AS (SELECT *, CASE WHEN clean = '' OR found = '' THEN 'not reported' ELSE found END AS n FROM f)
SELECT k, CASE WHEN answer <> '' AND NOT {_anyof('lower(answer)', detect.NO_NOVELTY)} THEN answer WHEN length(n) <= 100 THEN n ELSE regexp_replace(regexp_replace(substr(n, 1, 100), '\\s+\\S*$', ''), '[ ,;:\\-]+$', '') END AS novelty, {_excerpt()} AS excerpt,
  coalesce(list_filter(list_transform(string_split(evidence, chr(10)), lambda v: trim(v)), lambda v: length(v) BETWEEN 26 AND 199 AND NOT {_lowany(detect.NO_TITLE)})[1], '') AS title FROM g""",
    "q_auc_provenance": f"""WITH o AS (SELECT o_orderkey AS k, {AUC} AS auc, {AUC_BLOCK} AS block, 'T' || (o_orderkey % 4 + 1)::VARCHAR AS task FROM orders),
c AS (SELECT k, auc, task, unnest(regexp_split_to_array(trim(line), '\\s*[;|]\\s*|\\.\\s+')) AS clause FROM (SELECT k, auc, task, unnest(string_split(block, chr(10))) AS line FROM o) WHERE regexp_matches(line, '(?i)\\bAUCs?\\b')),
v AS (SELECT *, regexp_extract(clause, '\\b(?:0?\\.\\d{{2,4}}|1\\.00)\\b') AS num FROM c WHERE regexp_matches(clause, '(?i)\\bAUCs?\\b')),
w AS (SELECT *, substr(clause, greatest(1, strpos(clause, num) - 70)::BIGINT, (strpos(clause, num) - greatest(1, strpos(clause, num) - 70) + length(num) + 70)::BIGINT) AS near FROM v WHERE num <> '' AND round(num::DOUBLE, 3) = round(auc::DOUBLE, 3)),
l AS (SELECT k, task, CASE WHEN {_has('near', detect.HYBRID)} OR ({_has('near', detect.CONVERSION)} AND {_has('near', detect.AGAINST)}) THEN 'both' WHEN {_has('near', detect.CONVERSION)} THEN 'conversion' WHEN {_has('near', detect.AGAINST)} THEN 'detection' END AS label FROM w),
s AS (SELECT k, list_distinct(list(label)) AS labels FROM l WHERE label IS NOT NULL GROUP BY 1)
SELECT o.k, CASE WHEN task IN ('T1', 'T2', 'T3') THEN CASE WHEN task = 'T2' AND labels = ['detection'] THEN 'detection' WHEN task <> 'T2' AND labels = ['conversion'] THEN 'conversion' END END AS flag FROM o LEFT JOIN s USING (k)""",
    "q_candidate_flags": _S + f""", d AS (SELECT *, 'P-1 finds ' || substr(body, 1, 70) || CASE WHEN k % 3 = 0 THEN ' whereas P-2 finds more' ELSE ' and the' END AS i, CASE WHEN k % 4 = 0 THEN 'Evaluate fused models' ELSE 'Screening' END AS m, substr(body, 1, 50) AS a, 'Results 1 2 3 ' || section AS b,
  lower(opening || CASE WHEN k % 5 = 0 THEN ' needs an RCT of a drug by ICD' ELSE ' ' END) AS sc, regexp_split_to_array(regexp_replace('P-7 was kept. P-3 rejected; P-' || (k % 50)::VARCHAR || ' dropped. Held: P-9' || chr(10) || body, '([.;\\]])\\s+', '\\1' || chr(10), 'g'), chr(10)) AS se FROM p),
x AS (SELECT *, list_transform([i, m, a, b], lambda t: CASE WHEN rtrim(t, ' ' || chr(10)) <> '' AND NOT regexp_matches(rtrim(t, ' ' || chr(10)), '[.!?]$') THEN lower(regexp_replace(regexp_extract(rtrim(t, ' ' || chr(10)), '(\\S+)$', 1), '[^A-Za-z-]', '', 'g')) ELSE '' END) AS ends FROM d)
SELECT k, array_to_string(list_filter([CASE WHEN NOT {_has("i || ' ' || m", detect.GAP_MARK)} THEN 'NO_GAP_ARTICULATION' END, CASE WHEN NOT contains(i, 'P-2 finds') THEN 'PAPER_B_ABSENT' END,
    CASE WHEN {_has('a', detect.DOCUMENT_HEAD)} OR ({_has('a', detect.INTEGER_RUN)} AND NOT {_has('a', detect.METRIC_MARK)}) OR {_has('a', detect.LOST_SPACING)} OR {_has('b', detect.DOCUMENT_HEAD)} THEN 'RAW_EXTRACT_SOURCE' END, CASE WHEN starts_with(m, 'Evaluate fused ') THEN 'TEMPLATE_IMPLICATION' END,
    CASE WHEN contains(i, trim(a)) THEN 'TEMPLATE_INSIGHT' END, CASE WHEN len(list_filter(ends, lambda e: ends_with(e, '-') OR list_contains([{', '.join(_q(w) for w in detect.DANGLING)}], e))) > 0 THEN 'TRUNCATED_FIELD' END], lambda v: v IS NOT NULL), ',') AS flags,
  array_to_string(list_sort(list_filter([{', '.join(_q(h) for h in detect.OUT_OF_SCOPE)}], lambda h: contains(sc, h)))[1:4], ',') AS scope,
  array_to_string(list_sort(list_filter(list_distinct(flatten(list_transform(list_filter(se, lambda v: {_has('v', detect.REJECTIONS)}), lambda v: regexp_extract_all(v, '\\bP-\\d{{1,4}}\\b')))), lambda v: v NOT IN ('P-9', 'P-' || (k % 3)::VARCHAR))), ',') AS rejected,
  CASE WHEN length(trim(modality)) <= 60 AND NOT regexp_matches(modality, '[.;:!?*]') AND lower(modality) <> 'not reported' THEN modality WHEN k % 2 = 0 THEN 'structural mri' ELSE 'unspecified modality' END AS short,
  length(modality) <= 60 AND len(string_split(modality, ' ')) <= 6 AND NOT regexp_matches(modality, '[.!?"*:;]') AS clean FROM x""",
}
