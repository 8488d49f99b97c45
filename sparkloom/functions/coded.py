"""Readers of coded registry fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .missing import is_missing

# Categories, validation tiers and their thresholds.
CATEGORIES = ("C1", "C2", "C3", "C4", "C5", "C6")
TIER_THRESHOLDS = {"V1": 0.15, "V2": 0.08, "V3": 0.05, "V4": 0.03}
DEFAULT_THRESHOLD = 0.08
LONGITUDINAL = ("longitudinal_multipoint", "longitudinal_2point", "future_value_forecasting", "survival_analysis")
UNITS = r"(?:stud(?:y|ies)|papers?|articles?|publications?|trials?|rcts|records?|reviews|experts|datasets|cohorts)"


def leading_code(col: Column, letters: str, digits: str = "1-6") -> Column:
    """``V3`` of ``V3: k-fold``, or null."""
    code = F.regexp_extract(F.trim(F.coalesce(col, F.lit(""))), rf"^([{letters}][{digits}])", 1)
    return F.when(code != "", code)


def tier(col: Column) -> Column:
    return F.coalesce(leading_code(col, "V", "1-4"), F.lit("NR"))


def task(col: Column) -> Column:
    return F.coalesce(leading_code(col, "T"), F.lit("NR"))


def year(col: Column) -> Column:
    return F.regexp_extract(F.coalesce(col, F.lit("")), r"(\d{4})", 1).try_cast("int")


def domain(col: Column) -> Column:
    """One category, or OTHER for none and for several."""
    code = F.upper(F.trim(F.coalesce(col, F.lit(""))))
    return F.when(code.isin(*CATEGORIES), code).otherwise("OTHER")


def categories(col: Column, policy: str = "comma") -> Column:
    """Array of codes; writers join by ', ', readers split in different ways: ``comma``, ``slash`` or ``codes`` (any)."""
    text = F.upper(F.coalesce(col, F.lit("")))
    if policy == "codes":
        return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\bC[1-6]\b"), F.lit(0)))
    parts = F.split(text, "," if policy == "comma" else "/")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def sample_size(col: Column) -> Column:
    """Leading count without thousands commas; null for counts of studies and for zero."""
    text = F.regexp_replace(F.trim(F.coalesce(col, F.lit(""))), ",", "")
    shape = r"^\s*\**\s*(?:[Nn]\s*=\s*)?[~≈]?\s*(\d+(?:\.\d+)?)\s*(\S*)"
    n = F.regexp_extract(text, shape, 1).try_cast("double")
    return F.when(~F.regexp_extract(text, shape, 2).rlike("(?i)^" + UNITS) & (n > 0), n)


def design(col: Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower-cased design; all longitudinal ones are one."""
    text = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    for k, v in (aliases or {}).items():
        text = F.when(text == k, v).otherwise(text)
    return F.when(text.startswith("longitudinal"), "longitudinal").otherwise(text)


def yes_no(col: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    return F.when(text.isin("true", "yes", "1"), "Yes").when(text.isin("false", "no", "0"), "No").otherwise("NR")


def truthy(col: Column) -> Column:
    """True, False or null for anything else."""
    text = F.lower(F.trim(col))
    return F.when(text.isin("true", "yes", "1"), True).when(text.isin("false", "no", "0"), False)


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(100.0 * part, whole)


def proportion(col: Column) -> Column:
    """Percentages above 1.5 become parts of one; null outside 0..1."""
    v = F.when(col > 1.5, col / 100).otherwise(col)
    return F.when((v >= 0) & (v <= 1), v)


def paper_number(col: Column) -> Column:
    return F.regexp_extract(col, r"^P-(\d+)$", 1).try_cast("int")


def year_bucket(col: Column) -> Column:
    return F.when(col.isNull(), "undated").when(col < 2021, "early").otherwise(col.cast("string"))


def included(rows: DataFrame) -> DataFrame:
    """Rows that are neither duplicates nor out of scope."""
    scope = F.lower(F.coalesce(F.col("Modality"), F.lit("")))
    return rows.where(is_missing(F.col("duplicate_of"), "duplicate") & ~scope.rlike("out[-_]of[-_]scope"))


def derived(rows: DataFrame) -> DataFrame:
    """Registry rows with their typed codes."""
    return rows.withColumns({
        "tier": tier(F.col("Validation_Type")), "task": task(F.col("Task_Type")), "year": year(F.col("Publication_Year")),
        "domain": domain(F.col("Category")), "sample_n": sample_size(F.col("Sample_N_Approx")), "design": design(F.col("study_design_type")),
        "arch": F.trim(F.coalesce(F.col("Architecture_Family"), F.lit(""))), "has_xai": ~is_missing(F.col("XAI_Method"), "xai"),
    })


def filtered(rows: DataFrame, key: str, tokens: DataFrame, token: str) -> DataFrame:
    """Rows whose id is named by a token: ``P-12`` and ``12`` name each other. Without tokens all rows stay."""
    number = lambda c: F.regexp_extract(F.trim(c), r"(?i)^(?:P-)?(\d+)$", 1)
    named = lambda c: F.when(number(c) != "", F.concat(F.lit("#"), number(c))).otherwise(F.trim(c))
    wanted = tokens.where(F.trim(token) != "").select(named(token).alias("_named")).distinct()
    return rows if wanted.isEmpty() else rows.join(wanted, named(key) == F.col("_named"), "left_semi")
