"""From summary sections to coded registry rows: declared values, detectors, normalisation with notes, gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detect as detect_
from ..functions.coded import leading_code
from ..functions.missing import is_missing
from ..functions.text import asserted, compact
from . import registry_rules as rules_

# Phrases that exclude an abstract, in order.
EXCLUSIONS = (
    "animal model", "animal study", "mouse model", "rat model", "in vitro", "cell line", "no human", "pharmacological intervention",
    "drug trial", "case report", "single patient", "letter to the editor", "editorial", "conference abstract only",
)


# Labels that a section may put before its declared value.
LABEL = r"(?:category\s+assigned|assigned\s+category|(?:task|validation|architecture|method|modality|category)\s+assigned|assigned|category)\s*[:=]\s*"


def exclusion_reason(abstract: Column, phrases: Sequence[str] = EXCLUSIONS) -> Column:
    """The first phrase that occurs, or null."""
    text = F.lower(F.coalesce(abstract, F.lit("")))
    return F.coalesce(*[F.when(text.contains(p), F.lit(p)) for p in phrases])


def screen(df: DataFrame, abstract: str, confidence: str | None = None, least: float = 0.8) -> DataFrame:
    """Rows with ``reason`` and ``route``: excluded, borderline (confidence below ``least``) or kept."""
    out = df.withColumn("reason", exclusion_reason(F.col(abstract)))
    border = F.coalesce(F.col(confidence) < least, F.lit(False)) if confidence else F.lit(False)
    return out.withColumn("route", F.when(F.col("reason").isNotNull(), "excluded").when(border, "borderline").otherwise("kept"))


def best_category(text: Column, words: Mapping[str, Sequence[str]]) -> Column:
    """Category with most of its words in the text; the first on ties, null when none has any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scores = [F.struct(F.size(F.filter(F.array(*map(F.lit, w)), lambda x: low.contains(x))).alias("n"), F.lit(-i).alias("order"), F.lit(c).alias("category")) for i, (c, w) in enumerate(words.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["category"])


def declared_value(section: Column) -> Column:
    """What stands behind the section's own label (``Assigned:``, ``Category assigned =``), to the end of its line; null without a label."""
    value = F.regexp_extract(F.coalesce(section, F.lit("")), rf"(?i){LABEL}([^\n]+)", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(F.trim(value), r"^[*_ ]+|[*_ ]+$", ""), r"[.\s]+$", ""), F.lit(""))


def leading_declared(section: Column, letter: str) -> Column:
    """Code at the very start of a section, behind its label if it has one; codes in its prose are not read."""
    code = F.regexp_extract(F.trim(F.coalesce(section, F.lit(""))), rf"(?i)^[*_\s]*(?:{LABEL})?({letter}[1-8])\b", 1)
    return F.nullif(F.upper(code), F.lit(""))


def without_code(value: Column, letters: str = "TVCA") -> Column:
    """``V3: k-fold`` -> ``k-fold``."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), rf"^[{letters}]\d\s*[:\-–—(]?\s*", "")


def unique_declared(text: Column, pattern: str) -> Column:
    """What the pattern's group captures, if all its matches agree."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), F.lower))
    return F.when(F.size(found) == 1, found[0])


def detect(text: Column, rules: Sequence[tuple[str, str]], denial: bool = True) -> Column:
    """Name of the first rule whose pattern is asserted (not only denied) in a sentence."""
    holds = lambda p: asserted(text, p) if denial else F.coalesce(text.rlike(p), F.lit(False))
    return F.coalesce(*[F.when(holds(p), F.lit(n)) for n, p in rules])


def duplicate_of(text: Column) -> Column:
    """The paper that an explicit cross-reference names; a bare mention of duplicates names none."""
    n = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\b(?:same as|duplicate of|duplicates|identical to)\s+paper\s+(?:P-)?(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("P-"), n))


def first_year(text: Column, now: int) -> Column:
    """Year of a paper's text: in brackets before a number, in brackets near its DOI, in brackets, or plain, near its head; else the latest of the whole text. Years outside 1980 to next year are passed over."""
    t = F.coalesce(text, F.lit(""))
    head = F.substring(t, 1, 4000)
    year = "(20[0-3][0-9]|19[8-9][0-9])"
    every = lambda s, p: F.filter(F.transform(F.regexp_extract_all(s, F.lit(p), F.lit(1)), lambda y: y.try_cast("int")), lambda y: y.between(1980, now + 1))
    near = F.regexp_extract(head, r"(?is)https?://doi\.org/\S+(.{0,200})", 1)
    first = lambda s, p: F.get(every(s, p), F.lit(0))
    return F.coalesce(first(head, rf"\({year}\)\s+\d"), first(near, rf"\({year}\)"), first(head, rf"\({year}\)"), first(head, rf"\b{year}\b"), F.array_max(every(t, rf"\b{year}\b")))


# Most signs of each coded field.
WIDTHS = {"Modality": 330, "Method_Architecture": 180, "Best_Metric": 450, "Best_AUC": 82, "Dataset": 250, "Sample_N_Approx": 260, "Primary_Limitation": 600, "Open_Problems": 600, "Journal": 120, "Key_Novelty": 100}


def clean(text: Column, field: str) -> Column:
    """One line of at most the field's width; 'not reported' where there is nothing."""
    flat = F.substring(compact(text), 1, WIDTHS[field])
    return F.when(flat == "", "not reported").otherwise(flat)


def explicit_fields(sections: DataFrame, key: str = "pid") -> DataFrame:
    """Coded registry fields that a paper's sections state outright: one row a key; what is not stated is null, never guessed.

    ``sections`` (key, modality, task, validation, architecture, metric, auc, dataset, size, adni, novelty, limitation,
    venue, year) holds the text under each heading.
    """
    c = F.col
    codes = F.regexp_extract(F.regexp_replace(F.trim("modality"), rf"(?i)^[*_\s]*{LABEL}", ""), r"(?i)^[*_\s]*(C[1-6](?:\s*(?:,|/|&|\+|and)\s*C[1-6])+)\b", 1)
    several = F.array_join(F.array_distinct(F.regexp_extract_all(F.upper(codes), F.lit("C[1-6]"), F.lit(0))), ", ")
    category = F.when(codes != "", several).otherwise(leading_declared(c("modality"), "C"))
    prose = F.when(codes != "", F.regexp_replace(F.regexp_replace(F.trim("modality"), rf"(?i)^[*_\s]*(?:{LABEL})?[*_\s]*C[1-6](?:\s*(?:,|/|&|\+|and)\s*C[1-6])+", ""), r"^[\s\-–—:;,.=]+", "")).otherwise(detect_.strip_code_prefix(detect_.strip_label(c("modality"))))
    absent = lambda s: detect_.not_reported(c(s)) | detect_.denies_metric(c(s))
    number = F.nullif(F.regexp_extract(declared_value(c("auc")), r"^(0?\.\d+|[01](?:\.\d+)?)\b", 1), F.lit(""))
    head = F.lower(compact(detect_.strip_label(c("adni"))))
    first = F.regexp_replace(compact(F.regexp_extract(F.trim(detect_.strip_label(c("novelty"))), r"(?s)^(.*?)(?:\n\s*\n|\z)", 1)), r"(?i)\s*\((?:\d+\s*characters?|verified by count)[^)]*\)\s*$", "")
    given = lambda s, v: F.when(F.coalesce(c(s), F.lit("")) != "", v)
    return sections.select(
        key, category.alias("Category"), given("modality", F.coalesce(detect_.modality_label(clean(prose, "Modality")), F.when(category.isNotNull(), detect_.category_label(F.substring(category, 1, 2))))).alias("Modality"),
        leading_declared(c("task"), "T").alias("Task_Type"), leading_declared(c("validation"), "V").alias("Validation_Type"), leading_declared(c("architecture"), "A").alias("Architecture_Family"),
        given("metric", F.when(declared_value(c("metric")).isNotNull(), detect_.canonical_metric(declared_value(c("metric")))).when(absent("metric"), "NR").otherwise(clean(c("metric"), "Best_Metric"))).alias("Best_Metric"),
        given("auc", F.when(declared_value(c("auc")).isNotNull(), F.coalesce(number, F.lit("NR"))).when(absent("auc"), "NR").otherwise(clean(c("auc"), "Best_AUC"))).alias("Best_AUC"),
        given("dataset", clean(c("dataset"), "Dataset")).alias("Dataset"), given("size", clean(F.coalesce(declared_value(c("size")), F.regexp_replace(c("size"), r"^[*_\s]+", "")), "Sample_N_Approx")).alias("Sample_N_Approx"),
        F.when(head.rlike("^(?:true|yes)"), "true").when(head.rlike("^(?:false|no)"), "false").alias("ADNI_Dependent"), given("novelty", clean(F.when(first != "", first).otherwise(c("novelty")), "Key_Novelty")).alias("Key_Novelty"),
        given("limitation", clean(c("limitation"), "Primary_Limitation")).alias("Primary_Limitation"), given("venue", clean(c("venue"), "Journal")).alias("Journal"), F.nullif(F.regexp_extract("year", r"\b(19[8-9]\d|20[0-3]\d)\b", 1), F.lit("")).alias("Publication_Year"),
    )


def local_record(blocks: DataFrame, sections: DataFrame, key: str = "pid") -> DataFrame:
    """A registry row from a block alone: what its sections state, and what its prose tells of design, stage, population, sub-type, horizon, metric type, XAI and copies. ``blocks`` (key, title_line, opening, body)."""
    stated = explicit_fields(sections, key)
    d = blocks.join(stated, key, "left")
    task = F.coalesce("Task_Type", F.lit("T4"))
    return d.withColumns({
        "study_design_type": detect_.study_design(F.col("body"), F.col("opening"), F.col("title_line")), "task_substage": detect_.task_substage(F.col("body"), task), "population_specificity": detect_.population(F.col("opening")),
        "modality_subtype": detect_.modality_subtype(F.col("body")), "prediction_horizon_years": F.coalesce(detect_.prediction_horizon(F.col("body"), task).cast("string"), F.lit("not reported")), "primary_metric_type": detect_.metric_type(F.col("Best_Metric"), F.col("body")),
        "XAI_Method": F.coalesce(detect_.xai_declared(F.col("body")), F.lit("none")), "duplicate_of": F.coalesce(duplicate_of(F.col("body")), F.lit("not reported")),
    }).drop("title_line", "opening", "body")


def normalised_record(rows: DataFrame) -> DataFrame:
    """Registry rows within their vocabularies, with ``notes`` of every change: defaults of the coded columns, a name for bare proportions, canonical designs and metric types, malformed pointers and horizons reset."""
    c = lambda f: F.coalesce(f, F.lit(""))
    notes, out = [], {}

    def change(field: str, when: Column, value: Column, note: Column) -> None:
        out[field] = F.when(when, value).otherwise(c(field))
        notes.append(F.when(when, F.concat(F.lit(f"{field}: "), note)))

    bare = detect_.bare_proportion(F.col("Best_Metric")) & ~detect_.not_reported(F.col("Best_Metric"))
    change("Best_Metric", bare, F.concat(F.lit("Acc "), c("Best_Metric")), F.lit("bare proportion named"))
    for field, codes, default in (("Task_Type", "T[1-6]", "T4"), ("Validation_Type", "V[1-4]", "V2"), ("Architecture_Family", "A[1-8]", "A1")):
        change(field, ~c(field).rlike(f"^{codes}$"), F.lit(default), F.concat(F.lit(f"defaulted to {default} (was "), c(field), F.lit(")")))
    change("Key_Novelty", F.length(c("Key_Novelty")) > WIDTHS["Key_Novelty"], F.rtrim(F.substring(c("Key_Novelty"), 1, WIDTHS["Key_Novelty"])), F.lit("cut"))
    change("XAI_Method", c("XAI_Method").isin("", "not reported"), F.lit("none"), F.lit("set to none"))
    for field, canon in (("study_design_type", detect_.canonical_design), ("primary_metric_type", detect_.canonical_metric_type)):
        value = F.coalesce(canon(F.col(field)), F.lit("not reported"))
        change(field, value != c(field), value, F.concat(F.lit("was "), c(field)))
    change("population_specificity", ~c("population_specificity").isin(*rules_.POPULATIONS), F.lit("general"), F.concat(F.lit("reset from "), c("population_specificity")))
    change("task_substage", ~c("task_substage").isin(*rules_.SUBSTAGES), F.lit("not reported"), F.concat(F.lit("reset from "), c("task_substage")))
    change("duplicate_of", (c("duplicate_of") != "not reported") & ~c("duplicate_of").rlike(r"^P-\d+$"), F.lit("not reported"), F.concat(F.lit("reset from "), c("duplicate_of")))
    return rows.withColumn("notes", F.array_compact(F.array(*notes))).withColumns(out)


def normalised(df: DataFrame, allowed: Mapping[str, Sequence[str]], caps: Mapping[str, int], default: str = "NR") -> DataFrame:
    """Fields within their vocabularies and widths, with ``notes`` that say what was changed; nothing is changed silently."""
    notes, cols = [], {}
    for f, values in allowed.items():
        v = F.trim(F.coalesce(F.col(f), F.lit("")))
        known = v.isin(*values)
        cols[f] = F.when(known, v).otherwise(default)
        notes.append(F.when(~known & ~is_missing(F.col(f)), F.concat(F.lit(f"{f} not in vocabulary: "), v)))
    for f, n in caps.items():
        v = compact(F.col(f))
        cols[f] = F.when(F.length(v) <= n, v).otherwise(F.regexp_replace(F.substring(v, 1, n), r"\s+\S*$", ""))
        notes.append(F.when(F.length(v) > n, F.lit(f"{f} cut to {n}")))
    return df.withColumn("notes", F.array_compact(F.array(*notes))).withColumns(cols)


def conflict_inputs(rows: DataFrame) -> DataFrame:
    """Registry rows with the columns that ``pairs.registry_conflicts`` joins and gates on."""
    from ..functions import coded, metrics
    from .pairs import tier_threshold

    known = lambda c: F.when(is_missing(F.col(c), "gate"), "").otherwise(F.lower(F.trim(c)))
    usable = ~is_missing(F.col("Task_Type"), "gate") & ~is_missing(F.col("Dataset"), "gate") & ~is_missing(F.col("Modality"), "gate") & ~is_missing(F.col("Best_Metric"), "gate") & is_missing(F.col("duplicate_of"), "duplicate")
    out = rows.where(usable).withColumn("m", metrics.metric_parse(F.col("Best_Metric"))).where(F.col("m.mtype").isin(*metrics.PROPORTIONS))
    out = out.withColumns({
        "number": coded.paper_number(F.col("Paper_ID")), "task": coded.task(F.col("Task_Type")), "mtype": F.col("m.mtype"), "value": F.col("m.value"),
        "dataset_family": metrics.dataset_family(F.col("Dataset")), "modality_family": metrics.modality_family(F.col("Modality"), F.col("Method_Architecture")),
        "tier": F.coalesce(leading_code(F.col("Validation_Type"), "V", "1-4"), F.lit("V2")), "design": known("study_design_type"), "substage": known("task_substage"),
        "population": known("population_specificity"), "subtype": metrics.subtype_bucket(F.col("modality_subtype")),
    })
    out = out.withColumn("longitudinal", F.when(F.col("design") != "", F.col("design").isin(*coded.LONGITUDINAL)))
    return out.withColumn("tier_no", F.substring("tier", 2, 1).cast("int")).withColumn("threshold", tier_threshold(F.col("tier"))).drop("m")
