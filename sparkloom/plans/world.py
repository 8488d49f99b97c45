"""A registry and ledgers derived from the driver's tables, as one SQL text that Spark and the checking engine both read.

Customers stand for papers, orders and parts for ledger records, events for the log of gates. Every row of those
tables is used; the coded fields are written in the spellings that the readers must understand.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: One text a table; ``{name}`` is a driver table.
WORLD = {
    "registry": """
SELECT c_custkey AS k, c_nationkey AS nation, 'P-' || CAST(c_custkey + 1 AS STRING) AS Paper_ID,
  CASE c_custkey % 8 WHEN 0 THEN 'C1' WHEN 1 THEN 'C2' WHEN 2 THEN 'C3, C5' WHEN 3 THEN 'C4' WHEN 4 THEN 'C5' WHEN 5 THEN 'c6' WHEN 6 THEN 'C2/C4' ELSE 'not reported' END AS Category,
  CASE c_nationkey % 9 WHEN 0 THEN 'EEG spectral power' WHEN 1 THEN 'Structural MRI (T1)' WHEN 2 THEN 'resting-state fMRI' WHEN 3 THEN 'Speech transcripts' WHEN 4 THEN 'Plasma p-tau and APOE'
    WHEN 5 THEN 'Retinal fundus images' WHEN 6 THEN 'Gait sensors, wearable' WHEN 7 THEN 'Out-of-scope survey' ELSE 'MRI/PET fusion' END AS Modality,
  CASE c_custkey % 5 WHEN 0 THEN 'SVM' WHEN 1 THEN 'graph neural network' WHEN 2 THEN 'random forest' WHEN 3 THEN 'transformer' ELSE '' END AS Method_Architecture,
  CASE c_custkey % 7 WHEN 0 THEN 'T1' WHEN 1 THEN 'T2' WHEN 2 THEN 'T3' WHEN 3 THEN 'T4' WHEN 4 THEN 'T5' WHEN 5 THEN 'T6' ELSE 'not reported' END AS Task_Type,
  CASE c_custkey % 6 WHEN 0 THEN 'AUC 0.' || CAST(50 + c_custkey * 37 % 50 AS STRING) WHEN 1 THEN 'accuracy = ' || CAST(50 + c_custkey * 13 % 50 AS STRING) || '%' WHEN 2 THEN 'no accuracy; HR 1.' || CAST(10 + c_custkey % 90 AS STRING)
    WHEN 3 THEN 'not reported' WHEN 4 THEN '0.' || CAST(60 + c_custkey % 40 AS STRING) || ' AUC (95% CI 0.5-0.9)' ELSE 'F1 0.' || CAST(40 + c_custkey * 7 % 60 AS STRING) || '; kappa 0.' || CAST(10 + c_custkey % 80 AS STRING) END AS Best_Metric,
  CASE c_custkey % 4 WHEN 0 THEN '0.' || CAST(50 + c_custkey % 50 AS STRING) WHEN 1 THEN 'NR' WHEN 2 THEN 'about 0.9' ELSE '' END AS Best_AUC,
  CASE c_nationkey % 6 WHEN 0 THEN 'ADNI-2' WHEN 1 THEN 'OASIS-3' WHEN 2 THEN 'Local hospital, China' WHEN 3 THEN 'CHARLS survey' WHEN 4 THEN 'in-house cohort' ELSE 'NACC UDS' END AS Dataset,
  CASE c_custkey % 9 WHEN 0 THEN CAST(c_custkey + 10 AS STRING) || ' participants' WHEN 1 THEN 'N = ' || CAST(c_custkey % 400 AS STRING) WHEN 2 THEN CAST(c_custkey % 30 + 1 AS STRING) || ' studies' WHEN 3 THEN 'not reported'
    WHEN 4 THEN '~' || CAST(c_custkey % 200 + 5 AS STRING) WHEN 5 THEN '1,' || CAST(100 + c_custkey % 900 AS STRING) || ' adults' WHEN 6 THEN '**' || CAST(c_custkey % 50 AS STRING) WHEN 7 THEN '' ELSE 'n=' || CAST(c_custkey % 77 + 1 AS STRING) END AS Sample_N_Approx,
  CASE c_custkey % 11 WHEN 0 THEN 'V1' WHEN 1 THEN 'V2: 10-fold' WHEN 2 THEN 'V3' WHEN 3 THEN 'V4: external' WHEN 4 THEN 'none' WHEN 5 THEN 'V4' ELSE 'V2' END AS Validation_Type,
  CASE c_custkey % 6 WHEN 0 THEN 'pattern' WHEN 1 THEN 'marker' WHEN 2 THEN 'signal' WHEN 3 THEN 'trait' WHEN 4 THEN 'profile' ELSE 'index' END || ' of ' || CASE c_custkey % 3 WHEN 0 THEN 'cortical thickness' WHEN 1 THEN 'olfactory deficits' ELSE 'compensatory hyperactivation' END
    || CASE c_nationkey % 5 WHEN 0 THEN ' predicts ' WHEN 1 THEN ' marks ' WHEN 2 THEN ' precedes ' WHEN 3 THEN ' explains ' ELSE ' follows ' END || CASE c_nationkey % 4 WHEN 0 THEN 'conversion' WHEN 1 THEN 'reversion' WHEN 2 THEN 'stability' ELSE 'severity' END
    || ' among ' || CASE c_custkey % 5 WHEN 0 THEN 'older adults' WHEN 1 THEN 'veterans' WHEN 2 THEN 'nurses' WHEN 3 THEN 'farmers' ELSE 'retired teachers' END || ' visiting clinic' || CAST(c_custkey % 40 AS STRING) AS Key_Novelty,
  CASE c_nationkey % 5 WHEN 0 THEN 'needs ' WHEN 1 THEN 'wants ' WHEN 2 THEN 'lacks ' WHEN 3 THEN 'misses ' ELSE 'requires ' END || CASE c_custkey % 4 WHEN 0 THEN 'cortical thickness' WHEN 1 THEN 'external conversion cohorts' WHEN 2 THEN 'olfactory deficits' ELSE 'larger severity samples' END
    || CASE c_nationkey % 3 WHEN 0 THEN ' tested beyond' WHEN 1 THEN ' seen across' ELSE ' repeated outside' END || ' region' || CAST(c_nationkey AS STRING) AS Primary_Limitation,
  CASE c_custkey % 10 WHEN 9 THEN 'n.d.' ELSE CAST(2017 + c_custkey % 10 AS STRING) || ' (online)' END AS Publication_Year,
  CASE c_custkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'False' WHEN 2 THEN '' WHEN 3 THEN 'yes' ELSE 'maybe' END AS ADNI_Dependent,
  CASE c_custkey % 9 WHEN 0 THEN 'cross_sectional' WHEN 1 THEN 'longitudinal_multipoint' WHEN 2 THEN 'randomized_controlled_trial' WHEN 3 THEN 'systematic review' WHEN 4 THEN 'not reported' WHEN 5 THEN 'Survival_analysis' WHEN 6 THEN 'longitudinal_2point' WHEN 7 THEN 'pilot_design' ELSE '' END AS study_design_type,
  CASE c_custkey % 5 WHEN 0 THEN 'MCI_vs_HC' WHEN 1 THEN 'not reported' WHEN 2 THEN 'MCI_to_AD' WHEN 3 THEN '' ELSE 'multiclass_staging' END AS task_substage,
  CASE c_custkey % 4 WHEN 0 THEN 'general' WHEN 1 THEN 'PD' WHEN 2 THEN 'not reported' ELSE 'rural' END AS population_specificity,
  CASE c_custkey % 6 WHEN 0 THEN 'EEG_spectral' WHEN 1 THEN 'structural_MRI_only' WHEN 2 THEN 'not reported' WHEN 3 THEN 'PET + CSF' WHEN 4 THEN 'plasma_biomarkers' ELSE 'gait sensor' END AS modality_subtype,
  CASE c_custkey % 7 WHEN 0 THEN 'SHAP' WHEN 1 THEN 'none' WHEN 2 THEN 'Grad-CAM' WHEN 3 THEN 'not reported' WHEN 4 THEN 'magic' WHEN 5 THEN 'N/A' ELSE 'LIME' END AS XAI_Method,
  CASE c_custkey % 9 WHEN 0 THEN 'A1' WHEN 1 THEN 'A2' WHEN 2 THEN 'A3' WHEN 3 THEN 'A4' WHEN 4 THEN 'A5' WHEN 5 THEN ' A7 ' WHEN 6 THEN 'A9' ELSE '' END AS Architecture_Family,
  CASE c_custkey % 4 WHEN 0 THEN 'AUC_ROC' WHEN 1 THEN 'odds ratio' WHEN 2 THEN 'not reported' ELSE 'Weird Token' END AS primary_metric_type,
  CASE WHEN c_custkey % 23 = 0 THEN 'P-' || CAST(c_custkey % 19 + 1 AS STRING) WHEN c_custkey % 29 = 0 THEN 'non-research' WHEN c_custkey % 2 = 0 THEN 'not reported' ELSE '' END AS duplicate_of
FROM {customer}""",
    "conflicts": """
SELECT o_orderkey AS k, 'C-' || CAST(o_orderkey AS STRING) AS id, 'P-' || CAST(o_custkey + 1 AS STRING) AS paper_a, 'P-' || CAST((o_custkey * 7 + o_orderkey) % 1700 + 1 AS STRING) AS paper_b,
  CASE o_orderkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'Yes' WHEN 2 THEN 'false' WHEN 3 THEN '' END AS genuine_conflict, CASE o_orderkey % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'No' END AS genuine,
  CASE WHEN o_orderkey % 17 = 0 THEN 'waived by reviewer' END AS override_reason, o_orderkey % 3 = 0 AS g4_reviewed,
  CASE o_orderkey % 6 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'confirmed at G4' WHEN 2 THEN 'rejected' WHEN 3 THEN 'pending' WHEN 4 THEN 'candidate' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN '' END AS review_status,
  CASE WHEN o_orderkey % 31 <> 0 THEN 'claims ' || o_orderpriority END AS claim_a, CASE WHEN o_orderkey % 37 <> 0 THEN 'claims otherwise' ELSE '' END AS claim_b,
  CAST(o_orderkey % 40 AS DOUBLE) / 100 AS gap_magnitude, CASE o_orderkey % 4 WHEN 0 THEN 'partially_resolved_candidate' WHEN 1 THEN 'open' END AS resolution_status
FROM {orders}""",
    "findings": """
SELECT p_partkey AS k, 'VF-' || CAST(p_partkey AS STRING) AS id, CASE p_partkey % 5 WHEN 0 THEN 'include' WHEN 1 THEN 'include_with_caveat' WHEN 2 THEN 'pending G4' WHEN 3 THEN '' END AS manuscript_status,
  CASE p_partkey % 7 WHEN 0 THEN 'verified' WHEN 1 THEN 'demoted to claim' WHEN 2 THEN 'confirmed' WHEN 3 THEN 'pending review' WHEN 4 THEN '' END AS status, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size END AS BIGINT) AS evidence_count,
  CASE p_partkey % 6 WHEN 0 THEN 'longitudinal' WHEN 1 THEN 'cross_sectional' WHEN 2 THEN '' ELSE 'any' END AS required_design, CASE WHEN p_partkey % 41 <> 0 THEN p_name || ' improves ' || p_type END AS statement,
  CASE WHEN p_partkey % 4 = 0 THEN 'founded on P-' || CAST(p_partkey % 900 + 1 AS STRING) || ', P-' || CAST(p_partkey % 700 + 2 AS STRING) || ', P-' || CAST(p_partkey % 500 + 3 AS STRING) END AS note,
  CASE p_partkey % 8 WHEN 0 THEN 'multimodal' WHEN 1 THEN 'functional_mri' WHEN 2 THEN 'retinal' WHEN 3 THEN 'graph_nn' WHEN 4 THEN 'clinical_population' WHEN 5 THEN 'any' WHEN 6 THEN 'eeg_meg' ELSE 'novel_family' END AS required_family
FROM {part}""",
    "support": "SELECT DISTINCT 'VF-' || CAST(l_partkey AS STRING) AS id, 'P-' || CAST(l_orderkey % 1500 + 1 AS STRING) AS pid FROM {lineitem}",
    "invalidated": """
SELECT s_suppkey AS k, 'IA-' || CAST(s_suppkey AS STRING) AS id, CASE s_suppkey % 6 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'proposed_pending_g5' WHEN 2 THEN '' WHEN 3 THEN 'Confirmed at G5' WHEN 4 THEN 'rejected' END AS status, CASE s_suppkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'superseded' END AS review_status,
  'KA-' || CAST(s_nationkey * 2 AS STRING) AS assumption_id, 'P-' || CAST(s_suppkey * 11 % 1500 + 1 AS STRING) AS paper_id, s_suppkey % 10 = 5 AS gate_verified
FROM {supplier}""",
    "assumptions": "SELECT 'KA-' || CAST(n_nationkey AS STRING) AS assumption_id, n_name AS belief FROM {nation}",
    "gaps": """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'G-CAND-' || CAST(o_orderkey AS STRING) ELSE 'G-' || CAST(o_orderkey AS STRING) END AS id,
  CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'Corpus-wide absence: EEG modality never applied to reversion despite appearing in the corpus for all of the other tasks that were coded' WHEN 2 THEN 'MRI AND speech in the same cohort' WHEN 3 THEN 'No study has an external cohort; the only one is single-center'
    WHEN 4 THEN 'Missing cross-combination for T2: P-4 method with P-9 modality (or inverse)' WHEN 5 THEN 'No published study combines SVM with EEG for T1 prediction' WHEN 6 THEN 'Closure needs a policy reform and regulatory approval' ELSE 'limitation-derived gap of ' || o_orderpriority END AS gap_statement,
  CASE o_orderkey % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'Partially Open' WHEN 2 THEN '' WHEN 3 THEN 'closed' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'candidate' WHEN 2 THEN '' END AS current_status,
  CASE o_orderkey % 6 WHEN 0 THEN 'combinatorial' WHEN 1 THEN 'structural_absence' WHEN 2 THEN 'candidate' WHEN 3 THEN 'methodological' END AS gap_type, CASE o_orderkey % 7 WHEN 0 THEN 'derived' WHEN 1 THEN 'curated' END AS tier,
  CASE WHEN o_orderkey % 13 = 0 THEN 'UNRESOLVED' ELSE 'P-' || CAST(o_custkey + 1 AS STRING) END AS claim1, CASE WHEN o_orderkey % 2 = 0 THEN 'P-' || CAST(o_custkey * 3 % 1500 + 1 AS STRING) END AS claim2,
  CASE WHEN o_orderkey % 19 = 0 THEN 'curated by hand' END AS human_note, CASE WHEN o_orderkey % 8 = 0 THEN 'gate passed' END AS gate_marks, CASE WHEN o_orderkey % 11 = 0 THEN 'G5 review (delegated evaluator 2026-08-27) done' END AS note,
  CASE WHEN o_orderkey % 10 < 7 THEN 'Requires follow-up validated study addressing this limitation' ELSE 'a study with N>=50' END AS closure_criteria
FROM {orders}""",
    "complementary": """
SELECT o_orderkey AS k, 'CF-' || CAST(o_orderkey AS STRING) AS id, CASE o_orderkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'confirmed at G4' WHEN 2 THEN 'candidate' END AS status, CASE o_orderkey % 5 WHEN 0 THEN 'rejected at G6' END AS review_status,
  'P-' || CAST(o_custkey + 1 AS STRING) AS paper_a, 'P-' || CAST((o_custkey * 5 + 3) % 1600 + 1 AS STRING) AS paper_b,
  CASE o_orderkey % 5 WHEN 0 THEN 'P-' || CAST(o_custkey + 1 AS STRING) || ' finds a pattern' WHEN 1 THEN 'together they may improve robustness and generalisability of one and the same model in all of the many clinics that were ever asked to join' WHEN 2 THEN 'state and rate are two axes: a low score at baseline does not imply a steep slope, so that each of the two papers tells what the other cannot' END AS combined_insight,
  CASE o_orderkey % 7 WHEN 0 THEN 'Evaluate fused models' ELSE 'earlier screening' END AS clinical_implication
FROM {orders}""",
    "groups": "SELECT 'NI-' || CAST(c_nationkey AS STRING) AS gid, 'P-' || CAST(c_custkey + 1 AS STRING) AS pid, CASE c_nationkey % 3 WHEN 0 THEN 'hard_block' WHEN 1 THEN 'scope_limited' ELSE 'single_source' END AS enforcement, CASE c_nationkey % 2 WHEN 0 THEN 'Pattern' ELSE 'all' END AS scope, c_nationkey % 7 = 6 AS retired FROM {customer}",
    "flags": "SELECT 'P-' || CAST(c_custkey + 1 AS STRING) AS pid, CASE c_custkey % 41 WHEN 0 THEN 'commentary_editorial' WHEN 1 THEN 'not_a_study' WHEN 2 THEN 'overlap' ELSE 'none' END AS flag FROM {customer}",
    "gate_events": """
SELECT CASE event_id % 3 WHEN 0 THEN 'writer' ELSE 'coordinator' END AS agent, CASE event_type WHEN 'error' THEN 'failed' ELSE 'passed' END AS status, CASE event_id % 4 WHEN 0 THEN 'G5' ELSE 'G4' END AS gate,
  CASE event_id % 5 WHEN 0 THEN 'delegated pass of ' WHEN 1 THEN 'operator confirmed ' WHEN 2 THEN 'human review of ' ELSE 'noted ' END || 'C-' || CAST(event_id * 3 AS STRING) || ' and VF-' || CAST(event_id % 2000 AS STRING) AS reason
FROM {events}""",
}


def tables_of(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def world(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = WORLD[name]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(text)})


def ctes(*names: str) -> str:
    """``WITH name AS (...), ...`` of the named tables, for the checking engine."""
    return "WITH " + ",\n".join(f"{n} AS ({WORLD[n].format(**{t: t for t in tables_of(WORLD[n])})})" for n in names)
