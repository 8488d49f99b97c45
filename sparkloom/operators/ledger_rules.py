"""Integrity rules of the five ledgers: conflicts, consensus, invalidated assumptions, gaps and complementary findings.

Every function returns (id, severity, rule), one row a violation, from equi-joins of the ledger with the registry,
the groups of papers that are no independent evidence, and the log of gate events. ``lint.tally`` counts them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lint import messages

# What counts as missing here, flags of papers that are no evidence, first numbers written without review.
MISSING = ("", "not reported", "not_reported", "nr", "n/a", "na", "none")
NO_EVIDENCE = ("commentary_editorial", "conference_abstract", "not_a_study", "trial_protocol_no_results")
HANDOVER = {"CF": 194, "IA": 73, "VF": 32, "C": 235}
GATES = ("study_design_type", "task_substage", "population_specificity", "modality_subtype")
CONFIRMED = r"(?i)confirm|verified|include"
DELEGATED = r"(?i)delegated|state_file_reconciled|procedural pass|hand-typed|self-adjudicat"
REVIEWER = r"(?i)operator|human\(?s?\)? review|reviewer"
DELEGATED_GAP = r"(?i)G5 review \(delegated evaluator\s*2026-08-2[6-9]\)"
ABSENCE, SAME_COHORT = r"(?i)^corpus-wide absence:.{80,}", r"(?i)\bAND\b.*in the same cohort"
LIMITATION = r"(?i)\b(single[- ]cent(er|re)|small[- ]sample|no external validation|is cross-sectional)\b"
TEMPLATE, TEMPLATE_START = r"(?i)^P-\d+ finds ", "Evaluate fused "


def low(col: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))))


def missing(col: Column | str) -> Column:
    return low(col).isin(*MISSING)


def genuine(*flags: str) -> Column:
    """Truth of the first flag that is set; false where none is."""
    given = [F.when(F.coalesce(F.col(f), F.lit("")) != "", low(f).isin("true", "yes", "y", "1", "genuine")) for f in flags]
    return F.coalesce(*given, F.lit(False))


def in_handover(record_id: str = "id") -> Column:
    """Whether the id's number is at or above the first one of its prefix that was written without review."""
    number = F.regexp_extract(record_id, r"^[A-Z]+-(\d+)", 1).try_cast("int")
    first = F.lit(None).cast("int")
    for prefix, n in HANDOVER.items():
        first = F.when(F.regexp_extract(record_id, r"^([A-Z]+)-\d", 1) == prefix, n).otherwise(first)
    return F.coalesce(number >= first, F.lit(False))


def reviewed_ids(events: DataFrame) -> DataFrame:
    """(id) of records that a passed gate of the coordinator names, by a human reviewer: ``events`` (agent, status, gate, reason)."""
    human = events.where((F.col("agent") == "coordinator") & (F.col("status") == "passed") & F.col("gate").contains("G4") & F.col("reason").rlike(REVIEWER) & ~F.col("reason").rlike(DELEGATED))
    return human.select(F.explode(F.regexp_extract_all("reason", F.lit(r"\b(?:CF|IA|VF|C)-\d+"), F.lit(0))).alias("id")).distinct()


def self_certified(ledger: DataFrame, events: DataFrame, *statuses: str) -> DataFrame:
    """``ledger`` with ``self_certified``: confirmed in the handover window without a human gate, and not taken back."""
    human = reviewed_ids(events).withColumn("_human", F.lit(True))
    text = F.concat_ws(" ", *[F.coalesce(F.col(s), F.lit("")) for s in statuses])
    back = F.coalesce(F.col("reverted"), F.lit(False)) if "reverted" in ledger.columns else F.lit(False)
    return ledger.join(human, "id", "left").withColumn("self_certified", in_handover() & text.rlike(CONFIRMED) & F.col("_human").isNull() & ~back).drop("_human")


def gap_self_certified(status: Column, marks: Column, note: Column) -> Column:
    """An open gap whose only review is a delegated one in the window, with no other gate mark."""
    return status.isin("open", "partially_open") & (F.coalesce(marks, F.lit("")) == "") & F.coalesce(note, F.lit("")).rlike(DELEGATED_GAP)


def found(df: DataFrame, hard: Mapping[str, Column], soft: Mapping[str, Column]) -> DataFrame:
    """(id, severity, rule) of the rules that hold."""
    marks = lambda rules, s: F.transform(messages(rules), lambda r: F.struct(F.lit(s).alias("severity"), r.alias("rule")))
    return df.select("id", F.explode(F.concat(marks(hard, "hard"), marks(soft, "soft"))).alias("v")).select("id", "v.severity", "v.rule")


def in_window(text: Column, since: str) -> Column:
    """Whether a date in the record's text is ``since`` or later."""
    return F.exists(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"20\d\d-\d\d-\d\d"), F.lit(0)), lambda d: d >= since)


def _sides(ledger: DataFrame, registry: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The registry's columns of both papers as a_ and b_, null where there is no row."""
    for side in "ab":
        own = registry.select(F.col("Paper_ID").alias(f"paper_{side}"), F.lit(True).alias(f"{side}_row"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        ledger = ledger.join(own, f"paper_{side}", "left")
    return ledger


def _related(ledger: DataFrame, members: DataFrame) -> DataFrame:
    """``dependent``: whether both papers are in one group that must not be combined. ``members`` (gid, pid): papers meet in their groups, whose pairs are never written out."""
    own = members.select("gid", "pid").distinct()
    met = ledger.select("id", "paper_a", "paper_b").join(own.withColumnRenamed("pid", "paper_a"), "paper_a").join(own.withColumnRenamed("pid", "paper_b"), ["gid", "paper_b"]).where("paper_a <> paper_b")
    return ledger.join(met.select("id").distinct().withColumn("dependent", F.lit(True)), "id", "left").withColumn("dependent", F.coalesce("dependent", F.lit(False)))


def conflict_rules(conflicts: DataFrame, registry: DataFrame, members: DataFrame, events: DataFrame) -> DataFrame:
    """Conflicts (id, paper_a, paper_b, genuine_conflict, genuine, override_reason, g4_reviewed, status, review_status, claim_a, claim_b)."""
    df = _related(_sides(conflicts, registry, ("Task_Type", "duplicate_of", *GATES)), members)
    df = self_certified(df, events, "status", "review_status")
    waived = F.coalesce("override_reason", F.lit("")) != ""
    real = genuine("genuine_conflict", "genuine")
    own = real & ~waived
    both = F.col("a_row").isNotNull() & F.col("b_row").isNotNull()
    differ = lambda c: ~missing(f"a_{c}") & ~missing(f"b_{c}") & (F.trim(f"a_{c}") != F.trim(f"b_{c}"))
    copy = F.coalesce(F.col("a_duplicate_of").startswith("P-"), F.lit(False)) | F.coalesce(F.col("b_duplicate_of").startswith("P-"), F.lit(False))
    hard = {
        "paper without registry row": own & ~both,
        "task differs": own & both & ~F.col("a_Task_Type").eqNullSafe(F.col("b_Task_Type")),
        **{f"gate {c}": own & both & differ(c) for c in GATES},
        "sub-stage missing on both sides": own & both & missing("a_task_substage") & missing("b_task_substage"),
        "papers not independent": own & F.col("dependent"),
        "duplicate copy in pair": own & copy,
        "self-certified": F.col("self_certified"),
        "mandatory fields missing": (F.coalesce("id", F.lit("")) == "") | (F.coalesce("claim_a", F.lit("")) == "") | (F.coalesce("claim_b", F.lit("")) == ""),
    }
    soft = {"gates waived": real & waived, "genuine without gate mark": own & ~F.coalesce("g4_reviewed", F.lit(False)) & ~F.concat_ws(" ", "status", "review_status").rlike("(?i)g4")}
    return found(df, hard, soft)


def finding_shown(record_id: Column, manuscript: Column, status: Column, review: Column, supporters: Column) -> Column:
    """Whether the findings table shows a record: it has supporters and is not held; an explicit include decides, else its status must be neither demoted nor pending."""
    m, s, n = token(manuscript), token(status), F.coalesce(supporters, F.lit(0))
    held = m.startswith("exclude") | m.contains("candidate") | m.startswith("pending")
    out = s.rlike("retired|demoted|insufficient|superseded|deprecated|candidate") | s.startswith("pending") | token(record_id).contains("candidate")
    unmarked = (m == "") & (s == "") & (token(review) == "")
    return (n > 0) & ~held & (m.startswith("include") | (~out & ~(unmarked & (n < 3))))


def consensus_rules(findings: DataFrame, support: DataFrame, registry: DataFrame, members: DataFrame, flags: DataFrame, events: DataFrame) -> DataFrame:
    """Findings (id, manuscript_status, status, evidence_count, required_design, statement, note) with supporters (id, pid).

    Supporters are joined and counted in long form; nothing is gathered by finding but the ids that its note names.
    """
    support = support.distinct()
    own = registry.select(F.col("Paper_ID").alias("pid"), low("study_design_type").alias("design"), F.col("Validation_Type").alias("tier"), F.col("duplicate_of").alias("copy_of"))
    req = findings.select("id", low("required_design").alias("req"))
    marked = support.join(req, "id").join(own, "pid", "left").join(flags.where(F.col("flag").isin(*NO_EVIDENCE)).select("pid", F.lit(1).alias("no_evidence")).distinct(), "pid", "left")
    originals = support.join(own, "pid").where(_copies_of("copy_of")).select("id", F.col("copy_of").alias("pid"), F.lit(1).alias("has_copy")).distinct()
    marked = marked.join(originals, ["id", "pid"], "left")
    longitudinal = (F.col("req") == "longitudinal") & F.col("tier").isin("V3", "V4")
    off = ~F.col("req").isin("any", "") & (F.coalesce("design", F.lit("")) != "") & ~F.contains("design", F.col("req")) & ~F.coalesce(longitudinal, F.lit(False))
    copies = _copies_of("copy_of") | F.col("has_copy").isNotNull()
    counts = marked.groupBy("id").agg(F.count("*").alias("n"), F.count_if(off).alias("n_off"), F.count_if(copies).alias("n_copies"), F.count_if(F.col("no_evidence") == 1).alias("n_flagged"))
    grouped = support.join(members.select("gid", "pid").distinct(), "pid")
    x, y = (grouped.select("id", "gid", F.col("pid").alias(n)) for n in "ab")
    dependent = x.join(y, ["id", "gid"]).where("a < b").select("id", "a", "b").distinct().groupBy("id").agg(F.count("*").alias("n_pairs"))  # pairs within one finding's supporters
    named = findings.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("note", F.lit("")), F.lit(r"\bP-\d{1,4}\b"), F.lit(0)))).alias("pid"))
    lost = named.join(support.withColumn("_in", F.lit(1)), ["id", "pid"], "left").groupBy("id").agg(F.count("*").alias("n_named"), F.count_if(F.col("_in").isNull()).alias("n_lost"))
    df = self_certified(findings, events, "status", "manuscript_status").join(counts, "id", "left").join(dependent, "id", "left").join(lost, "id", "left").na.fill(0, ["n", "n_off", "n_copies", "n_flagged", "n_pairs", "n_named", "n_lost"])
    shown = finding_shown(F.col("id"), F.col("manuscript_status"), F.col("status"), F.lit(""), F.col("n"))
    hard = {
        "fewer than three supporters": shown & (F.col("n") < 3),
        "evidence count differs": shown & F.col("evidence_count").isNotNull() & (F.col("evidence_count") != F.col("n")),
        "supporters off the required design": shown & (F.col("n_off") > 0) & (F.col("n_off") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2))),
        "duplicate copies among supporters": shown & (F.col("n_copies") > 0),
        "papers that are no evidence": shown & (F.col("n_flagged") > 0),
        "self-certified": F.col("self_certified"),
        "no statement": F.coalesce("statement", F.lit("")) == "",
    }
    soft = {"supporters not independent": shown & (F.col("n_pairs") > 0), "founding papers lost": shown & (F.col("n_lost") >= 3) & (F.col("n_lost") > F.floor(F.col("n_named") / 2))}
    return found(df, hard, soft)


def _copies_of(column: str) -> Column:
    return F.coalesce(F.col(column).startswith("P-"), F.lit(False))


def invalidated_rules(invalidated: DataFrame, registry: DataFrame, assumptions: DataFrame, events: DataFrame) -> DataFrame:
    """Invalidated assumptions (id, status, review_status, assumption_id, paper_id, gate_verified)."""
    known = assumptions.select(F.col("assumption_id"), F.lit(True).alias("_known")).distinct()
    xai = registry.select(F.col("Paper_ID").alias("paper_id"), low("XAI_Method").alias("_xai"))
    df = self_certified(invalidated, events, "status", "review_status").join(known, "assumption_id", "left").join(xai, "paper_id", "left")
    confirmed = low("status").contains("confirm") | F.coalesce("gate_verified", F.lit(False))
    hard = {"unknown assumption": confirmed & F.col("_known").isNull(), "no status": F.coalesce("status", F.lit("")) == "", "self-certified": F.col("self_certified")}
    soft = {"paper without XAI method": confirmed & F.col("paper_id").isNotNull() & F.coalesce("_xai", F.lit("")).isin("none", "not reported", "")}
    return found(df, hard, soft)


def gap_rules(gaps: DataFrame, registry: DataFrame, events: DataFrame) -> DataFrame:
    """Gaps (id, gap_statement, status, current_status, claiming, gate_marks, note)."""
    copies = registry.where(_copies_of("duplicate_of")).select(F.col("Paper_ID").alias("pid"))
    on_copy = gaps.select("id", F.explode("claiming").alias("pid")).join(copies, "pid", "left_semi").select("id", F.lit(True).alias("_copy")).distinct()
    df = self_certified(gaps, events, "status", "current_status").join(on_copy, "id", "left")
    s, c = F.coalesce("status", F.lit("")), F.coalesce("current_status", F.lit(""))
    state = F.lower(F.when(s != "", s).otherwise(c))
    live = state.isin("open", "partially_open")
    text = F.coalesce("gap_statement", F.lit(""))
    hard = {
        "no statement": text == "",
        "no status": (s == "") & (c == ""),
        "status fields disagree": (s != "") & (c != "") & (F.lower(s) != F.lower(c)),
        "open on unresolved papers": live & F.array_contains("claiming", "UNRESOLVED"),
        "open on a duplicate copy": live & F.coalesce("_copy", F.lit(False)),
        "self-certified": F.col("self_certified") | gap_self_certified(state, F.col("gate_marks"), F.col("note")),
    }
    soft = {
        "statement looks combinatorial": live & (text.rlike(ABSENCE) | text.rlike(SAME_COHORT)),
        "limitation of a single paper": live & (F.size("claiming") <= 1) & text.rlike(LIMITATION),
    }
    return found(df, hard, soft)


def complementary_rules(findings: DataFrame, registry: DataFrame, members: DataFrame, events: DataFrame) -> DataFrame:
    """Complementary findings (id, status, paper_a, paper_b, combined_insight, clinical_implication)."""
    df = self_certified(_related(_sides(findings, registry, ("duplicate_of", "task_substage")), members), events, "status")
    confirmed = low("status").contains("confirm")
    hard = {
        "papers not independent": confirmed & F.col("dependent"),
        "duplicate copy in pair": confirmed & (_copies_of("a_duplicate_of") | _copies_of("b_duplicate_of")),
        "self-certified": confirmed & F.col("self_certified"),
    }
    soft = {
        "sub-stage missing on both sides": confirmed & missing("a_task_substage") & missing("b_task_substage"),
        "text from a template": confirmed & (F.coalesce("combined_insight", F.lit("")).rlike(TEMPLATE) | F.coalesce("clinical_implication", F.lit("")).startswith(TEMPLATE_START)),
    }
    return found(df, hard, soft)


# Filters of the published tables, and what enters them.

#: Marks of a status that keep a record out of a table.
DEAD = ("rejected", "demoted", "retired", "insufficient", "superseded", "deprecated", "invalid", "candidate", "awaiting")


def token(col: Column) -> Column:
    """Lower case, blanks and hyphens as one underscore."""
    return F.regexp_replace(low(col), r"[\s\-]+", "_")


def dead(*statuses: Column) -> Column:
    text = F.concat_ws(" ", *[token(s) for s in statuses])
    return text.rlike("|".join(DEAD))


def conflict_shown(flag: Column, status: Column, resolution: Column) -> Column:
    """The explicit flag first, and then only the record's own status may keep it out; without a flag any dead mark does."""
    f = low(flag)
    yes, no = f.isin("true", "yes", "y", "1", "genuine"), f.isin("false", "no", "n", "0")
    return F.when(yes, ~token(status).rlike("reject|retired")).when(no, False).otherwise(~dead(status, resolution) & ~token(F.concat_ws(" ", status, resolution)).contains("pending"))


def gap_state(status: Column, current: Column) -> Column:
    """Effective status, ``status`` first; '' where neither is set."""
    return token(F.when(F.coalesce(status, F.lit("")) != "", status).otherwise(current))


def gap_shown(gap_id: Column, status: Column, current: Column) -> Column:
    return gap_state(status, current).isin("open", "partially_open")


def candidate_gap(gap_id: Column, status: Column, current: Column, kind: Column) -> Column:
    state = gap_state(status, current)
    return ~state.isin("open", "partially_open") & (token(gap_id).startswith("g_cand_") | state.contains("candidate") | token(kind).contains("candidate"))


def invalidated_shown(status: Column, review: Column) -> Column:
    s = token(status)
    return (s != "") & ~dead(status, review) & ~s.rlike("proposed|pending|provisional|unreviewed")


def complementary_shown(status: Column, review: Column) -> Column:
    return token(status).contains("confirm") & ~dead(review)


def insight_ok(insight: Column, words: int = 20, banned: str = "may improve robustness and generalisability") -> Column:
    text = F.trim(F.coalesce(insight, F.lit("")))
    return ~F.lower(text).contains(banned) & (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) >= words)
