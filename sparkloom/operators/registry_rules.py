"""Integrity rules of registry rows: vocabularies, agreement with their summary block, prose in coded fields, copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detect
from .ledger_rules import found

# Spellings of missing, vocabularies of the coded columns, and how a block may name a method.
NA = ("NA", "N/A", "not reported", "not_reported", "NR", "")
XAI = ("none", "SHAP", "Grad-CAM", "LIME", "attention-map", "occlusion", "decision-tree", "fuzzy-rules", "integrated-gradients", "permutation-importance", "layer-wise-relevance-propagation", "NA", "not reported")
CODES = {"Task_Type": "T[1-6]", "Category": "C[1-6]", "Validation_Type": "V[1-4]", "Architecture_Family": "A[1-8]"}
DESIGNS = (
    "cross_sectional", "longitudinal_2point", "longitudinal_multipoint", "future_value_forecasting", "survival_analysis", "review_meta_analysis", "randomized_controlled_trial", "commentary_editorial", "case_control", "retrospective_cohort", "not reported",
)
METRIC_TYPES = (
    "AUC_ROC", "Accuracy", "Balanced_Accuracy", "C_index", "Sensitivity_Specificity", "PPV", "Hazard_Ratio", "Odds_Ratio", "F1", "effect_size", "Risk_Ratio", "Correlation", "Kappa", "MMSE_change", "descriptive", "prevalence", "regression_coefficient", "not reported",
)
POPULATIONS = ("general", "T2DM", "sarcopenia", "chronic_pain", "occupational_exposure", "CHF", "PD", "ESRD", "COPD", "other_disease_specific", "not reported")
SUBSTAGES = ("SCD_to_MCI", "NC_to_MCI", "pMCI_vs_sMCI", "MCI_to_AD", "EMCI_to_AD", "MCI_vs_HC", "multiclass_staging", "MCI_reversion", "biomarker_correlation", "aMCI_Apos_vs_Aneg", "awareness_survey", "not reported")
MENTIONS = {
    "Grad-CAM": r"grad-?cam|class activation|\bcam\b heat", "SHAP": r"\bshap\b|shapley", "LIME": r"\blime\b", "attention-map": r"attention[- ]?(?:maps?|heat-?maps?|weights?|scores?|visuali[sz]ation)|\bcbam\b|attention module",
    "occlusion": "occlusion", "decision-tree": r"decision tree|\bcart\b", "fuzzy-rules": "fuzzy", "integrated-gradients": "integrated gradients?|captum", "permutation-importance": "permutation importance|eli5|mean decrease",
    "layer-wise-relevance-propagation": r"layer-?wise relevance|\blrp\b|\brelevance propagation",
}
STUB = r"(?i)\[stub|duplicate|supplement-only|not a research"
#: Most signs of a field before it counts as prose.
WIDTHS = {"Modality": 80, "Best_Metric": 200, "Journal": 120}


def _text(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _outside(value: Column, allowed: tuple[str, ...] | str) -> Column:
    return ~value.isin(*NA) & (~value.rlike(f"^(?:{allowed})$") if isinstance(allowed, str) else ~value.isin(*allowed))


def registry_rules(registry: DataFrame, blocks: DataFrame, copies: DataFrame, subtypes: tuple[str, ...]) -> DataFrame:
    """(id, severity, rule) of registry rows against their blocks (pid, title, body, task, tier, arch, category, n_line, year, adni: heads of the block's sections) and ``copies`` (pid, original)."""
    b = blocks.select(F.col("pid").alias("Paper_ID"), *[F.col(c).alias(f"b_{c}") for c in blocks.columns if c != "pid"])
    d = registry.join(b, "Paper_ID", "left").join(copies.select(F.col("pid").alias("Paper_ID"), F.lit(True).alias("_copy")), "Paper_ID", "left").withColumn("id", F.col("Paper_ID"))
    block = F.col("b_body").isNotNull() & ~F.coalesce(F.col("b_title").rlike(STUB), F.lit(False))
    stub = F.coalesce(F.col("b_title").rlike(STUB), F.lit(False))
    parts = F.transform(F.split(_text("Category"), ","), lambda x: F.trim(x))
    hard = {f"{c} outside enum": _outside(_text(c), p) for c, p in CODES.items() if c != "Category"}
    hard["Category outside enum"] = F.exists(parts, lambda x: _outside(x, CODES["Category"]))
    hard["XAI_Method outside enum"] = _outside(_text("XAI_Method"), XAI)
    hard["ADNI_Dependent outside enum"] = ~F.lower(_text("ADNI_Dependent")).isin("true", "false", "na", "not reported", "")
    for column, head in (("Task_Type", "task"), ("Validation_Type", "tier"), ("Architecture_Family", "arch"), ("Category", "category")):
        code = F.regexp_extract(F.coalesce(f"b_{head}", F.lit("")), CODES[column], 0)
        hard[f"{column} disagrees with block"] = block & (code != "") & ~_text(column).isin(*NA) & ~F.contains(_text(column), code)
    year = F.regexp_extract(F.coalesce("b_year", F.lit("")), r"(?:19|20)\d{2}", 0)
    hard["Publication_Year disagrees with block"] = block & (year != "") & (_text("Publication_Year") != "") & (year != F.substring(_text("Publication_Year"), 1, 4))
    adni, own = F.lower(F.regexp_extract(F.coalesce("b_adni", F.lit("")), "(?i)true|false|yes|no", 0)), F.lower(_text("ADNI_Dependent"))
    hard["ADNI_Dependent disagrees with block"] = block & (adni != "") & own.isin("true", "false") & (adni.isin("true", "yes") != (own == "true"))
    xai = _text("XAI_Method")
    named = F.lit(False)
    for method, pattern in MENTIONS.items():
        named = F.when(xai == method, F.lower("b_body").rlike(pattern)).otherwise(named)
    hard["XAI_Method never mentioned"] = block & ~xai.isin("none", "NA", "", "not reported") & ~F.when(xai.isin(*MENTIONS), named).otherwise(F.contains(F.lower("b_body"), F.lower(F.substring_index(xai, "-", 1))))
    hard["duplicate of an earlier block"] = F.coalesce("_copy", F.lit(False)) & ~stub
    vocabulary = {"study_design_type": DESIGNS, "primary_metric_type": METRIC_TYPES, "modality_subtype": subtypes}
    soft = {f"{c} out of vocabulary": (_text(c) != "") & _outside(_text(c), v) for c, v in vocabulary.items()}
    soft |= {f"{c} out of vocabulary": (_text(c) != "") & ~_text(c).isin(*v) for c, v in (("population_specificity", POPULATIONS), ("task_substage", SUBSTAGES))}
    soft |= {f"{c} prose": F.length(F.coalesce(c, F.lit(""))) > n for c, n in WIDTHS.items() if c in registry.columns}
    soft["Modality holds justification"] = _text("Modality").rlike(r"(?i)\*\*|codebook|assignment")
    auc = _text("Best_AUC")
    soft["Best_AUC not a bare number"] = ~auc.isin(*NA) & ~auc.rlike(r"^0?\.\d+$|^1(?:\.0+)?$|^0\.\d+\s*[-/]\s*0\.\d+")
    soft["Best_AUC provenance"] = block & detect.auc_provenance(auc, _text("Task_Type"), F.col("b_body")).isNotNull()
    first = lambda c: F.replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"\d[\d,]*", 0), F.lit(","), F.lit(""))
    soft["Sample_N differs from block"] = block & (first(F.col("b_n_line")) != "") & (first(_text("Sample_N_Approx")) != "") & (first(F.col("b_n_line")) != first(_text("Sample_N_Approx")))
    return found(d, hard, soft)


def rewrite_reasons(body: Column, headers: tuple[str, ...], novelty: Column, year: Column, now: int, placeholder: str, most: int = 100) -> Column:
    """Sorted reasons to write a summary block anew: missing sections, placeholder text, page furniture or too long a novelty, a year out of range."""
    low = F.lower(F.coalesce(novelty, F.lit("")))
    lacking = F.lit(False)
    for h in headers:
        lacking = lacking | ~body.contains(h)
    y = F.regexp_extract(F.coalesce(year, F.lit("")), r"\b(\d{4})\b", 1).try_cast("int")
    rules = {"implausible_year": F.coalesce((y < 1980) | (y > now + 1), F.lit(False)), "missing_required_sections": lacking, "novelty_too_long": F.length(low) > most, "placeholder_language": body.contains(placeholder)}
    trigger = F.coalesce(*[F.when(low.contains(t), F.lit(f"novelty_trigger:{t}")) for t in detect.NO_NOVELTY])
    return F.array_sort(F.array_compact(F.array(trigger, *[F.when(c, F.lit(n)) for n, c in rules.items()])))
