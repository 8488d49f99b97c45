"""Text normalisers, tokens and similarity."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that are no content, by line of use.
STOP_WORDS = (
    "the and for with from that this into over under are is was were "
    "will across among between within against using use used study paper mci "
    "data model models method methods clinical evidence analysis based have has "
    "been being than then their there them also only very more most less"
).split()
# Page furniture that sticks to the end of a DOI.
FURNITURE = r"(abstract|keywords?:?|ios|page|ageing|jpad|brain|key)$"
NOISE = "�■□\u0000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm_text(col: Column) -> Column:
    return F.lower(F.trim(F.coalesce(col, F.lit(""))))


def norm_title(col: Column, gap: str = " ") -> Column:
    """Lower case, everything but letters and digits replaced by ``gap``."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]+", gap))


def norm_doi(col: Column) -> Column:
    out = F.rtrim(F.trim(F.coalesce(col, F.lit(""))), F.lit("."))
    out = F.regexp_replace(out, r"(?i)^(?:https?://)?(?:dx\.)?doi\.org/", "")
    out = F.lower(F.regexp_replace(out, r"(?i)^doi:\s*", ""))
    for _ in range(2):
        out = F.rtrim(F.regexp_replace(out, FURNITURE, ""), F.lit(":/-"))
    return out


def is_doi(col: Column) -> Column:
    return F.coalesce(col.rlike(r"^10\.\d{4,9}/.{3,}$"), F.lit(False))


def plausible_title(col: Column) -> Column:
    """Trimmed title, or null for short ones, file names and stubs."""
    text = F.trim(F.coalesce(col, F.lit("")))
    bad = text.rlike(r"(?i)\.pdf$|^pmid_|^1-s2\.0-|^\[stub|^not reported|^\[non-research")
    return F.when((F.length(text) >= 20) & ~bad, text)


def publisher_id(path: Column) -> Column:
    name = basename(path)
    pii, pmid = F.regexp_extract(name, r"^1-s2\.0-(S[0-9A-Za-z]+)-main\.pdf$", 1), F.regexp_extract(name, r"^PMID_(\d+)_", 1)
    return F.when(pii != "", F.concat(F.lit("PII:"), pii)).when(pmid != "", F.concat(F.lit("PMID:"), pmid))


def basename(path: Column) -> Column:
    name = F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)
    return F.when(name != "", name)


def tokens(col: Column, stop: list[str] | None = None) -> Column:
    """Distinct letter-led words of three signs or more without the stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(r"[a-z][a-z0-9\-]{2,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in (STOP_WORDS if stop is None else stop)]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both))


def compact(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " "))


def truncate_at_word(col: Column, most: int) -> Column:
    """At most ``most`` signs, cut at the last blank within them."""
    text = compact(col)
    head = F.substring(text, 1, most)
    cut = F.regexp_replace(F.regexp_replace(head, r"\s+\S*$", ""), r"[ ,;:\-]+$", "")
    return F.when(F.length(text) <= most, text).otherwise(cut)


def safe_words(col: Column, n: int) -> Column:
    """The first ``n`` runs of letters, digits and hyphens."""
    return F.array_join(F.slice(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"[A-Za-z0-9\-]+"), F.lit(0)), 1, n), " ")


def first_words(col: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(compact(col), " "), 1, n), " ")


def corruption(col: Column) -> Column:
    """Part of the signs that are noise; null for empty texts."""
    left = F.length(F.translate(col, NOISE, ""))
    return F.try_divide(F.length(col) - left, F.length(col))


def sentences(col: Column) -> Column:
    return F.split(F.coalesce(col, F.lit("")), r"(?<=[.!?;])\s+")


def asserted(col: Column, pattern: str, denial: str = r"(?i)\b(?:no|not|without|lack|lacks|absent|never)\b") -> Column:
    """Whether a sentence holds the pattern and no denial."""
    return F.exists(sentences(col), lambda s: s.rlike(pattern) & ~s.rlike(denial))


def subscripts(col: Column) -> Column:
    """C1, T2, A3, V4 with subscript digits."""
    out = col
    for digit, low in zip("0123456789", "₀₁₂₃₄₅₆₇₈₉", strict=True):
        out = F.regexp_replace(out, rf"\b([CTAV]){digit}\b", f"$1{low}")
    return out


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts (twice the matched signs by all signs)."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)
