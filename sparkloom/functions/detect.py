"""Detectors that read coded values out of prose: ordered rules, denials by sentence, declared values, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact, let, truncate_at_word

# Words that deny a statement or make it a wish.
DENIALS = (
    "did not", "does not", "do not", "didn't", "doesn't", "not used", "not applied", "none", "never", "without", "absent", "zero times",
    "lacks", "lacking", "future", "hypothetical", "would", "could", "such as", "instead of", "rather than",
)
DENIAL = r"(?i)\b(?:" + "|".join(DENIALS) + r")\b|\bno\s"


def _any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def asserted(text: Column, pattern: str) -> Column:
    """Whether the pattern stands somewhere in a sentence without a denial. A sentence runs from the last full stop or line break before it to the next full stop."""
    flat = F.coalesce(text, F.lit(""))

    def in_sentence(sentence: Column) -> Column:
        lines = F.split(sentence, "\n")
        rest = lambda i: F.array_join(F.slice(lines, i + 1, F.size(lines)), "\n")
        return F.exists(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike("(?i)" + pattern) & ~rest(i).rlike(DENIAL))

    return F.exists(F.split(flat, r"\. "), in_sentence)


def _words(words: Sequence[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


# Study designs in order, each with the part of the block it is read from, whether denials count, and its phrases.
DESIGNS = [
    ("commentary_editorial", "title_line", False, ("editorial", "commentary", "letter to the editor", "correspondence", "viewpoint", "invited comment", "guest editorial", "perspective piece")),
    ("commentary_editorial", "opening", False, ("invited commentary", "this commentary", "this editorial", "in this editorial", "letter to the editor", "commentary on the article", "we comment on", "the commentary reports no findings", "the editorial reports no")),
    ("review_meta_analysis", "block", False, ("systematic review", "meta-analysis", "narrative review", "review of the literature")),
    ("randomized_controlled_trial", "opening", False, ("randomised controlled trial", "randomized controlled trial", "randomised clinical trial", "randomized clinical trial", "randomised trial", "randomized trial", "placebo-controlled trial", "placebo controlled trial", "controlled clinical trial", "randomised, controlled", "randomized, controlled")),
    ("survival_analysis", "block", True, ("survival", "cox regression", "cox model", "cox proportional", "time-to-event", "time to conversion", "random survival forest", "c-index", "concordance index", "kaplan-meier", "kaplan meier")),
    ("future_value_forecasting", "block", True, ("future value", "forecast biomarker", "predict future", "forecasting model", "time-series inference", "dynamic prognosis", "forecast progression")),
    ("longitudinal_multipoint", "block", True, ("3 timepoint", "4 timepoint", "5 timepoint", "time points", "multiple visit", "repeated measure", "multi-timepoint", "multi-time-point", "multiple timepoints", "trajectory model")),
    ("cross_sectional", "block", False, ("cross-sectionally studied", "cross-sectional study", "cross-sectional design", "cross-sectional analysis", "cross-sectionally examined", "cross-sectional associations")),
    ("longitudinal_2point", "block", True, ("longitudinal", "follow-up visit", "follow-up assessment", "follow-up wave", "follow-up examination", "baseline and follow", "followed up for", "followed for")),
]
FOLLOW_UP = r"follow-?up (?:period |of |at |after |over )?(?:\d+|\w+) ?(?:months?|years?|weeks?)\b"


def study_design(block: Column, opening: Column, title_line: Column) -> Column:
    """First design whose phrases are met; ``cross_sectional`` where none is."""
    low = lambda c, name: F.lower(F.coalesce(c, F.lit(""))).alias(name)
    return let(F.struct(low(block, "block"), low(opening, "opening"), low(title_line, "title_line")), _design)


def _design(parts: Column) -> Column:
    tries = []
    for name, where, denied, words in DESIGNS:
        own = parts[where]
        hit = asserted(own, _words(words)) if denied else own.rlike(r"\b(?:" + _words(words) + r")\b") if where == "title_line" else _any(own, words)
        tries.append(F.when(hit, F.lit(name)))
    late = parts["block"].rlike(FOLLOW_UP) & asserted(parts["block"], "follow-up|follow up")
    return F.coalesce(*tries, F.when(late, F.lit("longitudinal_2point")), F.lit("cross_sectional"))


# Stages of the tasks that have one, and the words of conversion stages.
TASK_STAGES = {"T5": "MCI_reversion", "T1": "MCI_vs_HC", "T3": "multiclass_staging", "T4": "biomarker_correlation"}
PROGRESSIVE = ("pmci", "progressive mci", "stable mci", "smci", "p-mci", "s-mci")


def task_substage(block: Column, task: Column) -> Column:
    """Sub-stage within the coded task, so that a detection paper never gets a conversion stage."""
    low = F.lower(F.coalesce(block, F.lit("")))
    conversion = (
        F.when(_any(low, PROGRESSIVE), "pMCI_vs_sMCI")
        .when(low.contains("emci") & _any(low, ("conversion", " to ad")), "EMCI_to_AD")
        .when(low.contains("scd") & _any(low, ("mci", "progression")), "SCD_to_MCI")
        .otherwise("MCI_to_AD")
    )
    out = F.when(task == "T2", conversion)
    for code, stage in TASK_STAGES.items():
        out = out.when(task == code, stage)
    return out.otherwise("not reported")


# What governs an exclusion clause, and the conditions of a recruited population in order.
EXCLUSION = r"(?i)(?:\bexclu(?:ded|sion|ding)\b|\bineligible\b|\bnot eligible\b|\bwithout (?:a |any )?(?:history|diagnosis|evidence) of\b|\bno (?:history|diagnosis|evidence) of\b|\bfree (?:of|from)\b)[^.;\n]*[.;]?"
POPULATIONS = [
    ("CHF", ("heart failure", " chf ", "chf-mci", "cardiac")),
    ("PD", ("parkinson", "pd-mci", " pd ")),
    ("T2DM", ("type 2 diabetes", "t2dm", "diabetic")),
    ("sarcopenia", ("sarcopenia",)),
    ("chronic_pain", ("chronic pain", "fibromyalgia", "chronic low back pain", "chronic lower back pain", "clbp")),
    ("occupational_exposure", ("occupational", "miner", "pesticide", "dust exposure")),
    ("ESRD", ("renal", "esrd", "kidney disease", "dialysis")),
    ("COPD", ("copd", "chronic obstructive")),
]


def population(opening: Column) -> Column:
    """Condition of those recruited; clauses that exclude people are not read."""
    own = F.regexp_replace(F.lower(F.coalesce(opening, F.lit(""))), EXCLUSION, " ")
    return let(own, lambda low: F.coalesce(*[F.when(_any(low, words), F.lit(name)) for name, words in POPULATIONS], F.lit("general")))


# Modality sub-types in order: all of these patterns must be found, and (last) what the paper must then not lack.
SUBTYPE_RULES = [
    ("trimodal_MRI_PET_CSF", ("mri", "pet", "csf")), ("structural_MRI_PET", ("mri", "pet")), ("PET", (r"\bpet\b",)), ("SPECT", (r"\bspect\b",)), ("fNIRS", ("fnirs",)),
    ("EEG_graph_connectivity", ("eeg", "graph|connectivity")), ("EEG_spectral", ("eeg",)), ("acoustic_speech_features", ("speech", "acoustic|prosod")), ("transcriptomics", ("transcriptom",)),
    ("NLP_text_transcripts", ("transcript",)), ("NLP_clinical_notes", ("nlp|language model|clinical note",)), ("DNA_methylation", ("methylation|epigenetic",)),
    ("structural_MRI_plus_genetics", (r"\bprs\b|polygenic|\bsnps?\b|genom", "mri")), ("genetics_genomics", (r"\bprs\b|polygenic|\bsnps?\b|genom",)), ("gut_microbiome", ("microbiom",)), ("blood_metabolomics", ("metabolom|lipidom",)),
    ("clinical_EHR", ("ehr|electronic health record",)), ("driving_telemetry", ("driving|telemetry",)), ("handwriting_EEG", ("handwriting",)), ("retinal_OCT", (r"retina|\boct\b|fundus",)), ("plasma_biomarkers", ("plasma",)),
    ("serum_biomarkers", (r"\bserum\b",)), ("CSF_biomarkers", ("csf", "biomarker")), ("neuropsychological_scores_only", ("neuropsychological|mmse|moca|cognitive score",)), ("structural_MRI_only", ("mri",)),
]


def modality_subtype(block: Column) -> Column:

    def all_of(low: Column, patterns: Sequence[str]) -> Column:
        out = F.lit(True)
        for p in patterns:
            out = out & low.rlike(p)
        return out

    return let(F.lower(F.coalesce(block, F.lit(""))), lambda low: F.coalesce(*[F.when(all_of(low, patterns), F.lit(name)) for name, patterns in SUBTYPE_RULES], F.lit("not reported")))


# How a prediction horizon is stated, in order, with the unit of its number; signs around it that are read for an age.
CUES = r"(?:follow(?:ed|-| )?up|followup|within|over|after|horizon|predict(?:ed|ing|ion)?\s+(?:of\s+)?(?:conversion|progression|reversion)?|conversion\s+within|progression\s+within)"
HORIZONS = [
    (CUES + r"[^.]{0,40}?(\d+(?:\.\d+)?)\s*[-– ]?\s*year", 1.0),
    (r"(\d+(?:\.\d+)?)\s*[-– ]?\s*year[^.]{0,30}?(?:follow(?:ed|-| )?up|horizon|conversion|progression)", 1.0),
    (CUES + r"[^.]{0,40}?(\d+)\s*month", 12.0),
    (r"(\d+)\s*month[^.]{0,30}?(?:follow(?:ed|-| )?up|horizon|conversion|progression)", 12.0),
]
AGE = r"\bage[ds]?\b|\byears old\b"


def prediction_horizon(block: Column, task: Column) -> Column:
    """Years of the first plausible horizon (0.1 to 20) of a prediction task that does not stand beside an age; null where there is none."""
    return F.when(task.isin("T2", "T5"), let(F.lower(F.coalesce(block, F.lit(""))), _horizon))


def _horizon(low: Column) -> Column:
    tries = []
    for pattern, per_year in HORIZONS:
        # what is sought is tried first: looking back at every sign would cost sixty steps each
        around = rf"(?s)(?={pattern.replace('(\\d', '(?:\\d')})(?<=(\A.{{0,59}}|.{{60}})){pattern}(?=(.{{0,20}}))"
        part = lambda k: F.regexp_extract_all(low, F.lit(around), F.lit(k))  # noqa: B023, E731
        each = F.arrays_zip(part(0).alias("whole"), part(1).alias("before"), part(2).alias("number"), part(3).alias("after"))
        value = lambda m: F.round(m["number"].try_cast("double") / per_year, 1) if per_year > 1 else m["number"].try_cast("double")  # noqa: B023, E731
        near = F.filter(each, lambda m: ~F.concat(m["before"], m["whole"], m["after"]).rlike(AGE) & value(m).between(0.1, 20))  # noqa: B023
        tries.append(F.get(F.transform(near, value), F.lit(0)))
    return F.coalesce(*tries)


# Metric types of a best metric, by how its text begins, then by what it asserts.
METRIC_STARTS = [
    ("AUC_ROC", r"auc\b|sroc\b"), ("Balanced_Accuracy", r"bacc\b"), ("Accuracy", r"acc\b"), ("F1", r"f1\b"), ("not reported", r"kappa\b"), ("Sensitivity_Specificity", "sens|spec"),
    ("effect_size", r"smd\b|md\b|wmd\b|hedges|cohen|g\b|d\b"), ("Odds_Ratio", r"or\b"), ("Risk_Ratio", r"rr\b"), ("Hazard_Ratio", r"hr\b"), ("Correlation", r"r\b"),
]
METRIC_WORDS = [
    ("C_index", "c.?index"), ("Hazard_Ratio", "hazard"), ("Odds_Ratio", "odds"), ("Risk_Ratio", "risk ratio|relative risk"), ("effect_size", "standardi[sz]ed mean difference|mean difference"),
    ("AUC_ROC", r"\bauc\b"), ("Balanced_Accuracy", r"\bbacc\b"), ("Accuracy", r"\bacc\b"), ("F1", r"\bf1\b"),
]
PROSE_METRICS = [
    ("AUC_ROC", r"\bauc\b|\broc\b"), ("C_index", r"\bc-?index\b|\bconcordance\b"), ("Hazard_Ratio", r"\bhazard ratio\b|\bhr\b"), ("Odds_Ratio", r"\bodds ratio\b"),
    ("Balanced_Accuracy", r"\bbalanced accuracy\b|\bbacc\b"), ("F1", r"\bf1\b|\bf-score\b"), ("Accuracy", r"\baccuracy\b"),
]


def not_reported(text: Column) -> Column:
    """Whether a field says that its value is absent."""
    return F.lower(compact(text)).rlike(r"^(?:$|(?:nr|n/a|none)(?:$|\b\s*[.:;,-])|not reported|not applicable)")


def denies_metric(text: Column) -> Column:
    """Whether a field denies in a sentence that any metric was computed."""
    return compact(text).rlike(r"(?i)^(?:the\s+\w+\s+)?(?:paper|study|article|extract|authors)?\s*(?:reports?|computes?|contains?|provides?)?\s*no\s+(?:classification|discrimination|diagnostic|predictive|performance)?\s*(?:metric|accuracy|auc|statistic)")


def bare_proportion(text: Column) -> Column:
    """Whether a field is a number that can be a proportion, without a unit or a name behind it."""
    s = F.regexp_replace(compact(text), r"^[=~≈ ]+", "")
    shape = r"^(\d+(?:\.\d+)?)\s*(%?)\s*(.*)$"
    v, percent, rest = F.regexp_extract(s, shape, 1).try_cast("double"), F.regexp_extract(s, shape, 2) == "%", F.regexp_extract(s, shape, 3)
    return F.coalesce(~rest.rlike("^[A-Za-z]") & F.when(percent, v <= 100).otherwise(v <= 1), F.lit(False))


def metric_type(best: Column, block: Column, declared: Column | None = None) -> Column:
    """Metric type that is declared, else read from the best metric, else (without one) from the block's prose."""
    low = F.lower(F.trim(F.coalesce(best, F.lit(""))))
    own = lambda t: F.coalesce(*[F.when(t.rlike("^(?:" + p + ")"), F.lit(n)) for n, p in METRIC_STARTS], *[F.when(asserted(t, p), F.lit(n)) for n, p in METRIC_WORDS], F.lit("not reported"))
    prose = lambda t: F.coalesce(*[F.when(asserted(t, p), F.lit(n)) for n, p in PROSE_METRICS], F.lit("not reported"))
    read = F.when(low == "", let(F.lower(F.coalesce(block, F.lit(""))), prose)).when(not_reported(best), "not reported").otherwise(let(low, own))
    return read if declared is None else F.coalesce(declared, read)


# Names that a declared metric may begin with, in order.
METRIC_NAMES = ("bACC", "Acc", "AUC", "F1", "kappa", "Sens", "Spec", "NR", "OR", "HR", "RR", "SMD", "MD", "Beta", "rho", "C-index", "C-statistic", "Correlation", "Prevalence", "Incidence")


def canonical_metric(declared: Column, most: int = 450) -> Column:
    """``TYPE VALUE`` of a declared metric written in either order; NR where it says there is none."""
    names = "|".join(METRIC_NAMES)
    turned = rf"(?i)^([0-9][0-9.,]*\s*%?)\s+({names})\b"

    def canonical(s: Column) -> Column:
        name = F.lower(F.regexp_extract(s, turned, 2))
        canon = let(name, lambda x: F.coalesce(*[F.when(x == n.lower(), F.lit(n)) for n in METRIC_NAMES], x))
        return (
            F.when(s == "", "not reported")
            .when(not_reported(s) | denies_metric(s) | F.upper(s).isin("NR", "NONE"), "NR")
            .when(s.rlike(rf"(?i)^(?:{names})"), F.substring(s, 1, most))
            .when(name != "", F.concat(canon, F.lit(" "), F.trim(F.regexp_extract(s, turned, 1))))
            .otherwise(F.substring(s, 1, most))
        )

    return let(F.regexp_replace(compact(declared), r"\.+$", ""), canonical)


# Openings that justify a coding and are no label; the label of each category.
JUSTIFIES = r"(?i)^(?:the codebook|this assignment|assigned|because|the paper|the study|codebook|per the|following|i am|we |this is|the analysed|the analyzed|note[: ]|the choice|the coding|for the registry|registry)"
NO_DATA = r"(?i)\b(?:no (?:data|primary data|data domain|study modality|modality)|non-research|procedural document|no primary data)\b"
CATEGORY_LABELS = {
    "C1": "Neuroimaging (MRI/fMRI/DTI/PET)", "C2": "Electrophysiology (EEG/MEG/ERP/fNIRS)", "C3": "Molecular/fluid biomarkers (CSF/plasma/genomics)",
    "C4": "Behavioural/digital biomarkers (speech/gait/eye/sensor)", "C5": "Clinical/population data (EHR/surveys/neuropsych/cohorts)", "C6": "Peripheral/indirect markers (retinal/cardiac/other)",
}
#: Text in parentheses that are balanced, three deep.
_P1 = r"\([^()]*\)"
_P2 = rf"\((?:[^()]|{_P1})*\)"
PARENTHESES = rf"\((?:[^()]|{_P2})*\)"


def modality_label(prose: Column, most: int = 80) -> Column:
    """Short label of a modality field: its first clause outside parentheses, or null where it only justifies the coding."""
    s = F.regexp_replace(compact(prose), r"^[*_ ]+|[*_ ]+$", "")
    none = s.rlike(NO_DATA) & (F.length(s) < 400)
    s = F.regexp_replace(s, r"(?i)^(?:verbatim gloss|category|modality|assigned|why c\d)\s*[:=]\s*", "")
    s = F.trim(F.regexp_replace(s, r"^C[1-6]\s*(?:=|-|–|—|:)?\s*", ""))
    s = F.regexp_replace(s, rf"^{PARENTHESES}[\s\-–—:;,.=]*", "")
    return F.when(not_reported(prose), F.lit(None).cast("string")).when(none, "none (no primary data)").otherwise(let(s, lambda x: let(_clause(x), lambda c: F.when(_is_label(c, most), c))))


def _clause(s: Column) -> Column:
    """A clause of eight signs or more, up to the first stop, dash or comma that is not inside parentheses."""
    clause = F.trim(F.regexp_extract(s, rf"^((?:{PARENTHESES}|[^()]){{8,}}?)(?:(?<=[a-z0-9)\"])[.;](?:\s|$)|\s[-–—]\s|,\s)", 1))
    return F.when(clause != "", clause).otherwise(F.trim(s))


def _is_label(clause: Column, most: int) -> Column:
    return F.length(clause).between(3, most) & ~clause.rlike(JUSTIFIES) & ~clause.rlike(r"(?i)\*\*|\bcodebook\b|\bassignment\b")


_LABEL = r"(?:category\s+assigned|assigned\s+category|(?:task|validation|architecture|method|modality|category)\s+assigned|assigned|category)\s*[:=]\s*"


def strip_label(section: Column) -> Column:
    """A section without its leading labels and the bare code and separators behind each."""
    out = F.ltrim(F.coalesce(section, F.lit("")))
    for _ in range(3):
        out = F.regexp_replace(out, rf"(?i)^[*_\s]*{_LABEL}(?:[A-Z][1-8]\b[\s.,;:=\-]*)?[=\-–—:;,.\s]*", "")
    return out


def strip_code_prefix(section: Column) -> Column:
    """``C5 (label (more)) - prose`` without the code, its label in brackets or quotes, and the separators; with a capital."""
    return let(compact(section), _without_code)


def _without_code(s: Column) -> Column:
    rest = F.trim(F.regexp_replace(s, rf"^[*_\s]*[A-Z][1-8]\b(?:[\s\-–—:;,.=]*(?:{PARENTHESES}|\"[^\"]*\")){{0,4}}[\s\-–—:;,.=]*", ""))
    coded = s.rlike(r"^[*_\s]*[A-Z][1-8]\b")
    return F.when(~coded | (rest == ""), s).otherwise(F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, 2, 1 << 30)))


# Other names of study designs, of metric types and of XAI methods.
DESIGN_NAMES = {
    "randomized_controlled_trial": ("rct", "randomised_controlled_trial", "interventional_rct", "randomized_clinical_trial", "randomised", "randomized", "randomized_controlled_trial"),
    "commentary_editorial": ("non_research_editorial", "editorial", "commentary", "letter_to_the_editor", "correspondence", "letter", "commentary_editorial"),
    "review_meta_analysis": ("qualitative_systematic_review", "scoping_review", "umbrella_review", "systematic_review", "meta_analysis", "narrative_review", "systematic_review_meta_analysis", "network_meta_analysis", "systematic_review_network_meta_analysis", "review", "review_meta_analysis"),
    "cross_sectional": ("cross_sectional_study", "cross_sectional_survey", "cross_sectional_observational", "cross_sectional"),
    "survival_analysis": ("survival", "cox_regression", "time_to_event", "survival_analysis"),
}
METRIC_TYPE_NAMES = {
    "AUC_ROC": ("auc_roc", "auc", "roc_auc", "auroc", "auc_delong"), "Accuracy": ("accuracy",), "Balanced_Accuracy": ("balanced_accuracy",), "C_index": ("c_index", "concordance_index", "cindex", "c_statistic", "concordance"),
    "Sensitivity_Specificity": ("sensitivity_specificity", "sensitivity", "specificity", "sens_spec"), "PPV": ("ppv",), "Hazard_Ratio": ("hazard_ratio", "hr", "ahr", "adjusted_hazard_ratio"), "Odds_Ratio": ("odds_ratio", "or", "aor", "adjusted_odds_ratio"),
    "F1": ("f1",), "effect_size": ("effect_size", "smd", "hedges_g", "cohens_d", "cohen_d", "mean_difference", "standardised_mean_difference", "standardized_mean_difference"), "Risk_Ratio": ("risk_ratio", "rr", "relative_risk"),
    "Correlation": ("correlation", "spearman_correlation", "pearson_correlation", "correlation_coefficient"), "Kappa": ("kappa", "cohens_kappa", "cohen_kappa"), "MMSE_change": ("mmse_change",), "regression_coefficient": ("regression_beta", "beta", "beta_coefficient", "regression_coefficient"),
    "prevalence": ("prevalence_point_estimate", "prevalence"), "group_difference": ("group_difference",), "qualitative": ("qualitative",),
    "descriptive": ("descriptive", "observed_expected_ratio", "descriptive_time_interval", "threshold_estimate", "descriptive_statistics", "proportion", "proportion_descriptive"), "not reported": ("not_reported", "nr", "not_applicable", "na", "n_a", "not", "none", "no"),
}
XAI_NAMES = {
    "none": ("none",), "SHAP": ("shap", "shapley"), "Grad-CAM": ("grad-cam", "gradcam"), "LIME": ("lime",), "attention-map": ("attention-map", "attention map"), "occlusion": ("occlusion",), "decision-tree": ("decision-tree", "decision tree"), "fuzzy-rules": ("fuzzy-rules", "fuzzy rules"),
    "integrated-gradients": ("integrated gradients", "integrated-gradients"), "permutation-importance": ("permutation importance", "permutation-importance", "mean decrease accuracy"),
}
TOKEN = "^[A-Za-z][A-Za-z0-9_]{2,60}$"


def _token(value: Column, lower: bool = True) -> Column:
    raw = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "^[*\"'`]+|[*\"'`]+$", "")
    out = F.regexp_replace(F.regexp_replace(F.lower(raw) if lower else raw, "[ \\-]+", "_"), "^[_.]+|[_.]+$", "")
    return out


def _named(token: Column, names: dict[str, tuple[str, ...]]) -> Column:
    return F.coalesce(*[F.when(token.isin(*words), F.lit(name)) for name, words in names.items()])


def canonical_design(value: Column) -> Column:
    """Canonical study design of a declared token; a clean unknown token is kept, a shrug or prose is null."""
    t = _token(value)
    shrug = t.rlike("no_admissible|none_fits|does_not_fit|not_fit|unclear|unknown")
    return F.when((t == "") | shrug, F.lit(None).cast("string")).otherwise(F.coalesce(_named(t, DESIGN_NAMES), F.when(t.isin("not_reported", "nr", "not_applicable", "na", "not", "none", "no"), "not reported"), F.when(t.rlike(TOKEN) & ~F.trim(value).contains(" "), t)))


def canonical_metric_type(value: Column) -> Column:
    """Canonical metric type of a declared token; a clean unknown token is kept as written, prose is null."""
    t, own = _token(value), _token(value, lower=False)
    return F.when(t == "", F.lit(None).cast("string")).otherwise(F.coalesce(_named(t, METRIC_TYPE_NAMES), F.when(own.rlike(TOKEN), own)))


def xai_declared(text: Column) -> Column:
    """XAI method that a text declares outright, if it declares exactly one."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\bXAI[_ ]?Method\b\s*(?:for the registry\s*)?(?:is|:|=)\s*\"?([A-Za-z][A-Za-z \-]{2,20}?)\"?(?=[.,;)\s]|$)"), F.lit(1))
    tags = F.array_distinct(F.array_compact(F.transform(found, lambda x: _named(F.lower(F.trim(x)), XAI_NAMES))))
    return F.when(F.size(tags) == 1, F.get(tags, F.lit(0)))


def sample_size_prose(text: Column) -> Column:
    """First sample size that free text states, as written; null where it states none."""
    t = F.coalesce(text, F.lit(""))
    tries = (r"(?i)\bn\s*=\s*(\d+)", r"(?i)\(n[\s=]*(\d+)\)", r"(?i)(\d+)\s+(?:participants|subjects|patients|individuals|older adults|MCI patients|controls|healthy controls)")
    return F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in tries])


def category_label(code: Column) -> Column:
    return F.coalesce(*[F.when(code == c, F.lit(v)) for c, v in CATEGORY_LABELS.items()], F.lit("not reported"))


def short_modality(modality: Column, family: Column, most: int = 60) -> Column:
    """The modality where it is a label, else its family, else that it is unknown."""
    raw = compact(modality)
    clean = lambda c: ~c.rlike(r"[.;:!?*]")
    label = (raw != "") & (F.length(raw) <= most) & clean(raw) & ~F.lower(raw).isin("not reported", "not_reported", "nr", "n/a", "na", "none")
    return F.when(label, raw).when((F.coalesce(family, F.lit("")) != "") & (F.length(family) <= 40) & clean(family), F.regexp_replace(family, "_", " ")).otherwise("unspecified modality")


def clean_label(value: Column) -> Column:
    """Whether a modality family is short and without marks, fit for a gap statement."""
    s = F.trim(F.coalesce(value, F.lit("")))
    return (s != "") & (F.length(s) <= 60) & (F.size(F.split(s, " ")) <= 6) & ~s.rlike(r'[.!?"*:;]')


# Marks of summariser's scaffolding in a finding.
SCAFFOLD = (
    r"(?i)glyph|decoding convention|pdf extract|prisma figure|search yield|study flow|this assignment|codebook|\bassigned\s*:|\bpart [123]\b|the numbers below|^\s*note on\b|verbatim gloss|drafting|house style|"
    r"for the registry|reports no findings|no findings of its own|reports no (?:primary )?data|^\s*\*\*"
)


def scaffold(finding: Column) -> Column:
    """Whether a finding is no finding: empty, under five words, or drafting text."""
    text = F.trim(F.coalesce(finding, F.lit("")))
    return (text == "") | F.substring(text, 1, 240).rlike(SCAFFOLD) | (F.size(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))) < 5)


def skip_reason(block: Column, most: int = 80) -> Column:
    """Why a summary block is not to be extracted: a bracketed or corrigendum title, or an instruction in it; null where it is."""
    head = F.substring_index(F.coalesce(block, F.lit("")), "\n", 1)
    title = F.substring(F.trim(F.regexp_extract(head, r"^[^:]*:(.*)$", 1)), 1, most)
    return F.when(head.rlike(r"(?i)^##\s*Paper\s*[^:\n]+:\s*(?:\[|Corrigendum\b)"), title).when(block.rlike(r"(?is)SKIP(?:PED)?\b.{0,60}Agent\s*3|agents\s*\(3"), "block instructs downstream agents to skip")


# Texts that are no novelty, cues of one, metadata that leads a page.
NO_NOVELTY = ("contents lists available", "2.materials and methods", "study participants the data")
NOVELTY_CUES = r"\bwe\s+(?:propose|present|develop|introduce)\b|\bthis study\b|\bobjectives?\b|\bwe aimed\b|\bnovel\b|\bcontributions?\b"
PAGE_HEAD = ("contents lists available", "original article", "available online", "journal homepage", "www.elsevier.com", "sciencedirect")


def novelty(answer: Column, evidence: Column, most: int = 100) -> Column:
    """The answer where it is short and no page furniture, else the first sentence of the evidence with a cue, else its first long one."""
    given, clean = compact(answer), compact(evidence)
    furniture = lambda s: _any(F.lower(s), PAGE_HEAD)
    sentences = F.filter(F.split(clean, r"(?<=[.!?])\s+"), lambda s: s != "")
    usable = lambda s: ~_any(F.lower(s), NO_NOVELTY) & ~(furniture(s) & ~_any(F.lower(s), ("study", "propose", "model", "framework", "method")))
    cued = F.get(F.filter(sentences, lambda s: usable(s) & F.lower(s).rlike(NOVELTY_CUES)), F.lit(0))
    long = F.get(F.filter(sentences, lambda s: ~furniture(s) & (F.length(s) >= 30)), F.lit(0))
    found = F.coalesce(cued, F.trim(F.regexp_replace(F.coalesce(long, F.get(sentences, F.lit(0)), clean), "(?i)contents lists available.*$", "")))
    derived = F.when(clean == "", "not reported").otherwise(truncate_at_word(F.when(found == "", "not reported").otherwise(found), most))
    ok = (given != "") & ~_any(F.lower(given), NO_NOVELTY) & (F.length(given) <= most)
    return F.when(ok, given).otherwise(derived)


def excerpt(text: Column, patterns: Sequence[str], fallback: Column | str = "not reported", most: int = 450, reach: int = 700) -> Column:
    """Text from the first place of the first pattern that occurs, blanks collapsed; else the head of the text."""
    whole = F.coalesce(text, F.lit(""))
    low = F.lower(whole)
    cut = lambda at: F.substring(compact(F.substring(whole, at, F.lit(reach))), 1, most)
    found = [F.when(F.instr(low, F.lit(p)) > 0, cut(F.instr(low, F.lit(p)))) for p in patterns]
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(whole == "", other).otherwise(F.coalesce(*found, F.nullif(cut(F.lit(1)), F.lit("")), other))


# Marks of lines that are not a title.
NO_TITLE = ("available online", "elsevier", "contents lists", "journal homepage", "all rights reserved", "creativecommons", "https://doi", "sciencedirect")


def page_title(head: Column, most: int = 3000) -> Column:
    """First line of 26 to 199 signs near the head of a page that is no page furniture; '' where there is none."""
    lines = F.transform(F.split(F.substring(F.coalesce(head, F.lit("")), 1, most), "\n"), lambda x: F.trim(x))
    fit = F.filter(lines, lambda x: F.length(x).between(26, 199) & ~_any(F.lower(x), NO_TITLE))
    return F.coalesce(F.get(fit, F.lit(0)), F.lit(""))


# Instruments by design, in order.
INSTRUMENTS = [
    ("RoB 2 (randomised trials)", "randomi"), ("ROBIS / AMSTAR 2 (evidence syntheses)", "review|meta_analysis|meta-analysis"),
    ("PROBAST (prognostic models) or ROBINS-E (cohort exposures)", "survival|longitudinal|cohort|multi_cohort|predictive_model|prognos"), ("QUADAS-2 (diagnostic accuracy) or ROBINS-E (associations)", "case_control|cross_sectional|cross-sectional"),
]


def instrument(design: Column) -> Column:
    """Instrument that an appraisal of the design would use."""
    low = F.lower(F.coalesce(design, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(p), F.lit(n)) for n, p in INSTRUMENTS], F.lit("not assigned (design not coded)"))


# Hints that a gap's closure lies outside the field.
OUT_OF_SCOPE = (
    "phase 3", "randomised placebo", "randomized placebo", "rct", "clinical trial", "regulatory", "dsm", "icd", "consensus workshop", "qaly", "health economics",
    "clinical pharmacology", "pharmacological", "drug", "genomics consortium",
)


def out_of_scope(statement: Column, closure: Column, most: int = 4) -> Column:
    """Up to four of the hints that a gap names, in order; empty where it is in scope."""
    low = F.lower(F.concat_ws(" ", F.coalesce(statement, F.lit("")), F.coalesce(closure, F.lit(""))))
    return F.slice(F.array_sort(F.array_compact(F.array(*[F.when(low.contains(h), F.lit(h)) for h in OUT_OF_SCOPE]))), 1, most)


# Cues that a sentence rejects the papers it names.
REJECTIONS = r"(?i)\b(?:rejected|reject|removed|pruned|dropped|reversed|struck|excluded|held|not a supporter|does not support|counter-evidence|counterevidence)\b"


def rejected_papers(fields: Sequence[Column], supporters: Column, listed: Column | None = None) -> Column:
    """Ids that the record's sentences reject or its list names, without current supporters."""
    sentences = F.flatten(F.array(*[F.split(F.coalesce(f, F.lit("")), r"(?<=[.;\]])\s+|\n") for f in fields]))
    named = F.flatten(F.transform(F.filter(sentences, lambda s: s.rlike(REJECTIONS)), lambda s: F.regexp_extract_all(s, F.lit(r"\bP-\d{1,4}\b"), F.lit(0))))
    every = F.concat(named, F.coalesce(listed, F.array().cast("array<string>"))) if listed is not None else named
    return F.array_sort(F.array_except(F.array_distinct(every), F.coalesce(supporters, F.array().cast("array<string>"))))


# Languages in which a best AUC may be labelled: conversion, patients against controls, and both.
CONVERSION = (
    r"(?i)\bpMCI\b|\bsMCI\b|conversion|convert\w*|\b(?:NC|CN|MCI|EMCI|LMCI|HC|SCD)\s*(?:to|-to-|→)\s*(?:MCI|AD|dementia|EMCI|LMCI)\b|progress\w* (?:to|at)|incident (?:alzheimer|dementia)|prognos\w*|"
    r"transition\w* (?:to|risk)|future (?:alzheimer|dementia)|development (?:of|among)|follow-?up|predict\w* (?:future|conversion|progression|dementia)|reversion"
)
_SICK, _WELL = "(?:MCI|aMCI|naMCI|AD|dementia)", "(?:HC|NC|CN|normal controls?|healthy controls?|controls?|cognitively normal)"
AGAINST = (
    rf"(?i)\b{_SICK}\s*(?:vs\.?|versus|from|and)\s*{_WELL}\b|\b{_WELL}\s*(?:vs\.?|versus|from|and)\s*{_SICK}\b|"
    r"\b(?:detection|discrimination|distinguish\w*|classification) (?:of|between|for) (?:MCI|aMCI|AD)(?: patients?)? (?:and|from|versus) (?:healthy )?(?:controls?|HC|NC|CN)\b"
)
HYBRID = r"(?i)conversion[- ]classif\w*|classif\w*[- ]conversion"


def auc_provenance(auc: Column, task: Column, block: Column, reach: int = 70) -> Column:
    """``conversion`` or ``detection`` where all labels beside the row's AUC in its block speak of the other task than the coded one; null elsewhere.

    Clauses of lines that name an AUC are read; a label counts within ``reach`` signs of the value.
    """
    value = F.round(F.regexp_extract(F.coalesce(auc, F.lit("")), r"^(0\.\d+|1(?:\.0+)?)$", 1).try_cast("double"), 3)
    clauses = F.flatten(F.transform(F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: x.rlike(r"(?i)\bAUCs?\b")), lambda x: F.split(F.trim(x), r"\s*[;|]\s*|\.\s+")))
    spot = rf"(?=[01.])(?<=(\A.{{0,{reach - 1}}}|.{{{reach}}}))(\b(?:0?\.\d{{2,4}}|1\.00)\b)(?=(.{{0,{reach}}}))"
    part = lambda c, k: F.regexp_extract_all(c, F.lit(spot), F.lit(k))
    near = lambda c: F.arrays_zip(part(c, 1).alias("before"), part(c, 2).alias("number"), part(c, 3).alias("after"))
    spots = F.flatten(F.transform(F.filter(clauses, lambda c: c.rlike(r"(?i)\bAUCs?\b")), near))
    own = F.filter(spots, lambda m: (F.round(m["number"].try_cast("double"), 3) == value) & (value >= 0.5))

    def label(m: Column) -> Column:
        text = F.concat(m["before"], m["number"], m["after"])
        c, v = text.rlike(CONVERSION), text.rlike(AGAINST)
        return F.when(text.rlike(HYBRID) | (c & v), "both").when(c, "conversion").when(v, "detection").otherwise("none")

    labels = F.array_distinct(F.filter(F.transform(own, label), lambda x: x != "none"))
    only = lambda name: (F.size(labels) == 1) & (F.get(labels, F.lit(0)) == name)
    return F.when(value.isNotNull() & task.isin("T1", "T2", "T3"), F.when((task == "T2") & only("detection"), "detection").when((task != "T2") & only("conversion"), "conversion"))


# Marks of the seven quality flags of a complementary candidate.
DOCUMENT_HEAD = r"(?i)^\s*(?:results?|resulting in|introduction|methods?|discussion|conclusions?|abstract|contents lists)\b"
INTEGER_RUN = r"\b\d{1,2}\b(?:\s+\b\d{1,2}\b){2,}"
METRIC_MARK = r"(?i)AUC|SMD|\bCI\b|\bOR\b|\bHR\b|accuracy|sensitivity|specificity|NPV|PPV|prevalence|p\s*[<=]|n\s*=|%|studies|participants|subjects|patients|RCTs|yr\d|Hz|fold"
LOST_SPACING = r"\S{25,}|\w+- \w+|classi er"
GAP_MARK = r"(?i)whereas|however|neither|in contrast|remains unknown|untested|no study has|complement"
DANGLING = (
    "a an the and or but of in on for with to by at from as that which while than is are was were has have had been also both between during after before into over under more less when where "
    "these this their its such including versus vs"
).split()


def quality_flags(insight: Column, implication: Column, finding_a: Column, finding_b: Column, paper_b: Column) -> Column:
    """Sorted codes of what is wrong with a complementary candidate; they advise and never reject."""
    i, m, a, b = (F.coalesce(c, F.lit("")) for c in (insight, implication, finding_a, finding_b))
    head = F.trim(F.substring(a, 1, 60))
    last = lambda t: F.lower(F.regexp_replace(F.element_at(F.split(F.rtrim(t), r"\s+"), -1), "[^A-Za-z-]", ""))
    cut = lambda t: (F.rtrim(t) != "") & ~F.rtrim(t).rlike(r"[.!?]$") & (last(t).endswith("-") | last(t).isin(*DANGLING))
    raw = lambda t: (t != "") & (t.rlike(DOCUMENT_HEAD) | (t.rlike(INTEGER_RUN) & ~t.rlike(METRIC_MARK)) | t.rlike(LOST_SPACING))
    rules = {
        "NO_GAP_ARTICULATION": ~F.concat_ws(" ", i, m).rlike(GAP_MARK),
        "PAPER_B_ABSENT": (F.coalesce(paper_b, F.lit("")) != "") & ~F.contains(i, F.concat(F.coalesce(paper_b, F.lit("")), F.lit(" finds"))),
        "RAW_EXTRACT_SOURCE": raw(a) | raw(b),
        "TEMPLATE_IMPLICATION": F.ltrim(m).startswith("Evaluate fused "),
        "TEMPLATE_INSIGHT": i.startswith("P-") & (head != "") & F.contains(i, head),
        "TRUNCATED_FIELD": cut(i) | cut(m) | cut(a) | cut(b),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
