"""Integrity rules, filters and summaries of the ledgers, over the derived world."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger_rules
from .world import ctes, world


def hard_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, pid) of the groups that are in force and must not be combined."""
    return world(spark, sf_dir, "groups").where("enforcement = 'hard_block' and not retired").select("gid", "pid")


def _w(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [world(spark, sf_dir, n) for n in names]


def q_lint_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    conflicts, registry, events = _w(spark, sf_dir, "conflicts", "registry", "gate_events")
    return ledger_rules.conflict_rules(conflicts, registry, hard_members(spark, sf_dir), events)


def q_lint_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, support, registry, flags, events = _w(spark, sf_dir, "findings", "support", "registry", "flags", "gate_events")
    return ledger_rules.consensus_rules(findings, support, registry, hard_members(spark, sf_dir), flags, events)


def q_lint_invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_rules.invalidated_rules(*_w(spark, sf_dir, "invalidated", "registry", "assumptions", "gate_events"))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world(spark, sf_dir, "gaps").withColumn("claiming", F.array_compact(F.array("claim1", "claim2")))


def q_lint_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry, events = _w(spark, sf_dir, "registry", "gate_events")
    return ledger_rules.gap_rules(_gaps(spark, sf_dir), registry, events)


def q_lint_complementary(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, registry, events = _w(spark, sf_dir, "complementary", "registry", "gate_events")
    return ledger_rules.complementary_rules(findings, registry, hard_members(spark, sf_dir), events)


def q_tables_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which records of each ledger the published tables show."""
    conflicts, findings, support, invalidated, complementary = _w(spark, sf_dir, "conflicts", "findings", "support", "invalidated", "complementary")
    c = lambda x: F.col(x)
    n = support.distinct().groupBy("id").agg(F.count("*").alias("n"))
    parts = [
        conflicts.select(F.lit("conflict").alias("ledger"), "id", ledger_rules.conflict_shown(F.coalesce(F.nullif("genuine_conflict", F.lit("")), "genuine"), c("status"), c("resolution_status")).alias("shown")),
        findings.join(n, "id", "left").select(F.lit("finding").alias("ledger"), "id", ledger_rules.finding_shown(c("id"), c("manuscript_status"), c("status"), F.lit(""), c("n")).alias("shown")),
        invalidated.select(F.lit("invalidated").alias("ledger"), "id", ledger_rules.invalidated_shown(c("status"), c("review_status")).alias("shown")),
        complementary.select(F.lit("complementary").alias("ledger"), "id", (ledger_rules.complementary_shown(c("status"), c("review_status")) & ledger_rules.insight_ok(c("combined_insight"))).alias("shown")),
        _gaps(spark, sf_dir).select(F.lit("gap").alias("ledger"), "id", (ledger_rules.gap_shown(c("id"), c("status"), c("current_status")) & ~ledger_rules.candidate_gap(c("id"), c("status"), c("current_status"), c("gap_type"))).alias("shown")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_since_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text names a day on or after the start of a window."""
    d = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.concat_ws(" ", F.lit("reviewed"), F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority", F.lit("again 2001-02-30"))
    return d.where(ledger_rules.in_window(text, "2001-01-01") & ledger_rules.in_window(F.concat_ws(" ", F.lit("by"), F.date_format("o_orderdate", "yyyy-MM-dd")), "2000-06-15")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (q_lint_conflicts, q_lint_consensus, q_lint_invalidated, q_lint_gaps, q_lint_complementary, q_tables_shown, q_since_window)}


def _low(x: str) -> str:
    return f"lower(trim(coalesce({x}, '')))"


def _miss(x: str) -> str:
    return f"({_low(x)} IN ('', 'not reported', 'not_reported', 'nr', 'n/a', 'na', 'none'))"


def _rows(rules: dict[str, str], severity: str) -> str:
    return ", ".join(f"CASE WHEN {c} THEN struct_pack(severity := '{severity}', rule := '{r}') END" for r, c in rules.items())


def _found(hard: dict[str, str], soft: dict[str, str], source: str) -> str:
    return f"SELECT id, v.severity AS severity, v.rule AS rule FROM (SELECT id, unnest(list_filter([{_rows(hard, 'hard')}, {_rows(soft, 'soft')}], lambda x: x IS NOT NULL)) AS v FROM {source})"


_COMMON = r"""
hp AS (SELECT DISTINCT a.pid AS a, b.pid AS b FROM groups a JOIN groups b ON a.gid = b.gid AND a.pid < b.pid WHERE a.enforcement = 'hard_block' AND NOT a.retired),
reviewed AS (SELECT DISTINCT unnest(regexp_extract_all(reason, '\b(?:CF|IA|VF|C)-\d+')) AS id FROM gate_events WHERE agent = 'coordinator' AND status = 'passed' AND contains(gate, 'G4')
  AND regexp_matches(reason, '(?i)operator|human\(?s?\)? review|reviewer') AND NOT regexp_matches(reason, '(?i)delegated|state_file_reconciled|procedural pass|hand-typed|self-adjudicat'))"""


def _selfcert(*statuses: str) -> str:
    text = " || ' ' || ".join(f"coalesce({s}, '')" for s in statuses)
    number = r"try_cast(regexp_extract(id, '^[A-Z]+-(\d+)', 1) AS INT)"
    first = r"CASE regexp_extract(id, '^([A-Z]+)-\d', 1) WHEN 'CF' THEN 194 WHEN 'IA' THEN 73 WHEN 'VF' THEN 32 WHEN 'C' THEN 235 END"
    return f"(coalesce({number} >= {first}, false) AND regexp_matches({text}, '(?i)confirm|verified|include') AND id NOT IN (SELECT id FROM reviewed))"


def _sides(columns: tuple[str, ...]) -> str:
    return ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in columns)


_GATES = ("study_design_type", "task_substage", "population_specificity", "modality_subtype")
_T = "regexp_replace(lower(trim(coalesce({}, ''))), '[\\s\\-]+', '_', 'g')"
_DEAD = "rejected|demoted|retired|insufficient|superseded|deprecated|invalid|candidate|awaiting"
_OWN = "(real AND NOT waived)"
_BOTH = "(a_row AND b_row)"

SQL = {
    "q_lint_conflicts": ctes("registry", "conflicts", "groups", "gate_events") + "," + _COMMON + f""",
j AS (SELECT c.*, a.Paper_ID IS NOT NULL AS a_row, b.Paper_ID IS NOT NULL AS b_row, {_sides(("Task_Type", "duplicate_of", *_GATES))}, coalesce(override_reason, '') <> '' AS waived,
    CASE WHEN coalesce(genuine_conflict, '') <> '' THEN {_low('genuine_conflict')} IN ('true', 'yes', 'y', '1', 'genuine') WHEN coalesce(genuine, '') <> '' THEN {_low('genuine')} IN ('true', 'yes', 'y', '1', 'genuine') ELSE false END AS real,
    EXISTS (SELECT 1 FROM hp WHERE hp.a = least(paper_a, paper_b) AND hp.b = greatest(paper_a, paper_b)) AS dependent
  FROM conflicts c LEFT JOIN registry a ON a.Paper_ID = paper_a LEFT JOIN registry b ON b.Paper_ID = paper_b)
"""
    + _found(
        {
            "paper without registry row": f"{_OWN} AND NOT {_BOTH}",
            "task differs": f"{_OWN} AND {_BOTH} AND a_Task_Type IS DISTINCT FROM b_Task_Type",
            **{f"gate {c}": f"{_OWN} AND {_BOTH} AND NOT {_miss('a_' + c)} AND NOT {_miss('b_' + c)} AND trim(a_{c}) <> trim(b_{c})" for c in _GATES},
            "sub-stage missing on both sides": f"{_OWN} AND {_BOTH} AND {_miss('a_task_substage')} AND {_miss('b_task_substage')}",
            "papers not independent": f"{_OWN} AND dependent",
            "duplicate copy in pair": f"{_OWN} AND (coalesce(starts_with(a_duplicate_of, 'P-'), false) OR coalesce(starts_with(b_duplicate_of, 'P-'), false))",
            "self-certified": _selfcert("status", "review_status"),
            "mandatory fields missing": "coalesce(claim_a, '') = '' OR coalesce(claim_b, '') = ''",
        },
        {"gates waived": "real AND waived", "genuine without gate mark": f"{_OWN} AND NOT g4_reviewed AND NOT regexp_matches(coalesce(status, '') || ' ' || coalesce(review_status, ''), '(?i)g4')"},
        "j",
    ),
    "q_lint_consensus": ctes("registry", "findings", "support", "groups", "flags", "gate_events") + "," + _COMMON + f""",
m AS (SELECT s.id, s.pid, {_low('f.required_design')} AS req, {_low('r.study_design_type')} AS design, r.Validation_Type AS tier, coalesce(starts_with(r.duplicate_of, 'P-'), false) AS is_copy,
    EXISTS (SELECT 1 FROM support o JOIN registry x ON x.Paper_ID = o.pid WHERE o.id = s.id AND x.duplicate_of = s.pid) AS has_copy,
    EXISTS (SELECT 1 FROM flags g WHERE g.pid = s.pid AND g.flag IN ('commentary_editorial', 'conference_abstract', 'not_a_study', 'trial_protocol_no_results')) AS flagged
  FROM support s JOIN findings f USING (id) LEFT JOIN registry r ON r.Paper_ID = s.pid),
c AS (SELECT id, count(*) AS n, count(*) FILTER (req NOT IN ('any', '') AND design <> '' AND NOT contains(design, req) AND NOT (req = 'longitudinal' AND coalesce(tier IN ('V3', 'V4'), false))) AS n_off,
    count(*) FILTER (is_copy OR has_copy) AS n_copies, count(*) FILTER (flagged) AS n_flagged FROM m GROUP BY 1),
d AS (SELECT x.id, count(*) AS n_pairs FROM hp JOIN support x ON x.pid = hp.a JOIN support y ON y.pid = hp.b AND y.id = x.id GROUP BY 1),
l AS (SELECT id, count(*) AS n_named, count(*) FILTER ((id, pid) NOT IN (SELECT (id, pid) FROM support)) AS n_lost FROM (SELECT DISTINCT id, unnest(regexp_extract_all(note, '\\bP-\\d{{1,4}}\\b')) AS pid FROM findings WHERE note IS NOT NULL) GROUP BY 1),
t AS (SELECT f.*, coalesce(c.n, 0) AS n, coalesce(n_off, 0) AS n_off, coalesce(n_copies, 0) AS n_copies, coalesce(n_flagged, 0) AS n_flagged, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_named, 0) AS n_named, coalesce(n_lost, 0) AS n_lost,
    {_T.format('manuscript_status')} AS ms, {_T.format('status')} AS st FROM findings f LEFT JOIN c USING (id) LEFT JOIN d USING (id) LEFT JOIN l USING (id)),
j AS (SELECT *, n > 0 AND NOT (starts_with(ms, 'exclude') OR contains(ms, 'candidate') OR starts_with(ms, 'pending')) AND (starts_with(ms, 'include') OR (NOT (regexp_matches(st, 'retired|demoted|insufficient|superseded|deprecated|candidate') OR starts_with(st, 'pending')) AND NOT (ms = '' AND st = '' AND n < 3))) AS shown FROM t)
"""
    + _found(
        {
            "fewer than three supporters": "shown AND n < 3",
            "evidence count differs": "shown AND evidence_count <> n",
            "supporters off the required design": "shown AND n_off > 0 AND n_off >= greatest(1, n // 2)",
            "duplicate copies among supporters": "shown AND n_copies > 0",
            "papers that are no evidence": "shown AND n_flagged > 0",
            "self-certified": _selfcert("status", "manuscript_status"),
            "no statement": "coalesce(statement, '') = ''",
        },
        {"supporters not independent": "shown AND n_pairs > 0", "founding papers lost": "shown AND n_lost >= 3 AND n_lost > n_named // 2"},
        "j",
    ),
    "q_lint_invalidated": ctes("registry", "invalidated", "assumptions", "groups", "gate_events") + "," + _COMMON + f""",
j AS (SELECT i.*, (contains({_low('i.status')}, 'confirm') OR gate_verified) AS confirmed, a.assumption_id IS NOT NULL AS known, {_low('r.XAI_Method')} AS xai FROM invalidated i LEFT JOIN assumptions a USING (assumption_id) LEFT JOIN registry r ON r.Paper_ID = i.paper_id)
"""
    + _found(
        {"unknown assumption": "confirmed AND NOT known", "no status": "coalesce(status, '') = ''", "self-certified": _selfcert("status", "review_status")},
        {"paper without XAI method": "confirmed AND paper_id IS NOT NULL AND xai IN ('none', 'not reported', '')"},
        "j",
    ),
    "q_lint_gaps": ctes("registry", "gaps", "groups", "gate_events") + "," + _COMMON + r""",
j AS (SELECT *, lower(CASE WHEN coalesce(status, '') <> '' THEN status ELSE current_status END) AS state, [claim1] || CASE WHEN claim2 IS NULL THEN [] ELSE [claim2] END AS claiming FROM gaps),
c AS (SELECT Paper_ID AS pid FROM registry WHERE starts_with(duplicate_of, 'P-'))
"""
    + _found(
        {
            "no statement": "gap_statement = ''",
            "no status": "coalesce(status, '') = '' AND coalesce(current_status, '') = ''",
            "status fields disagree": "coalesce(status, '') <> '' AND coalesce(current_status, '') <> '' AND lower(status) <> lower(current_status)",
            "open on unresolved papers": "state IN ('open', 'partially_open') AND list_contains(claiming, 'UNRESOLVED')",
            "open on a duplicate copy": "state IN ('open', 'partially_open') AND (claim1 IN (SELECT pid FROM c) OR coalesce(claim2 IN (SELECT pid FROM c), false))",
            "self-certified": _selfcert("status", "current_status") + r" OR (state IN ('open', 'partially_open') AND coalesce(gate_marks, '') = '' AND regexp_matches(coalesce(note, ''), '(?i)G5 review \(delegated evaluator\s*2026-08-2[6-9]\)'))",
        },
        {
            "statement looks combinatorial": r"state IN ('open', 'partially_open') AND (regexp_matches(gap_statement, '(?i)^corpus-wide absence:.{80,}') OR regexp_matches(gap_statement, '(?i)\bAND\b.*in the same cohort'))",
            "limitation of a single paper": r"state IN ('open', 'partially_open') AND len(claiming) <= 1 AND regexp_matches(gap_statement, '(?i)\b(single[- ]cent(er|re)|small[- ]sample|no external validation|is cross-sectional)\b')",
        },
        "j",
    ),
    "q_lint_complementary": ctes("registry", "complementary", "groups", "gate_events") + "," + _COMMON + f""",
j AS (SELECT c.*, contains({_low('status')}, 'confirm') AS confirmed, {_sides(("duplicate_of", "task_substage"))}, EXISTS (SELECT 1 FROM hp WHERE hp.a = least(paper_a, paper_b) AND hp.b = greatest(paper_a, paper_b)) AS dependent
  FROM complementary c LEFT JOIN registry a ON a.Paper_ID = paper_a LEFT JOIN registry b ON b.Paper_ID = paper_b)
"""
    + _found(
        {
            "papers not independent": "confirmed AND dependent",
            "duplicate copy in pair": "confirmed AND (coalesce(starts_with(a_duplicate_of, 'P-'), false) OR coalesce(starts_with(b_duplicate_of, 'P-'), false))",
            "self-certified": "confirmed AND " + _selfcert("status"),
        },
        {
            "sub-stage missing on both sides": f"confirmed AND {_miss('a_task_substage')} AND {_miss('b_task_substage')}",
            "text from a template": "confirmed AND (regexp_matches(coalesce(combined_insight, ''), '(?i)^P-\\d+ finds ') OR starts_with(clinical_implication, 'Evaluate fused '))",
        },
        "j",
    ),
    "q_tables_shown": ctes("conflicts", "findings", "support", "invalidated", "complementary", "gaps") + f""",
cf AS (SELECT id, {_low("coalesce(nullif(genuine_conflict, ''), genuine)")} AS flag, {_T.format('status')} AS st, {_T.format('resolution_status')} AS rs FROM conflicts),
vf AS (SELECT f.id, coalesce(n, 0) AS n, {_T.format('manuscript_status')} AS ms, {_T.format('status')} AS st FROM findings f LEFT JOIN (SELECT id, count(*) AS n FROM support GROUP BY 1) USING (id)),
ia AS (SELECT id, {_T.format('status')} AS st, {_T.format('review_status')} AS rs FROM invalidated),
co AS (SELECT id, {_T.format('status')} AS st, {_T.format('review_status')} AS rs, trim(coalesce(combined_insight, '')) AS insight FROM complementary),
gp AS (SELECT id, {_T.format("CASE WHEN coalesce(status, '') <> '' THEN status ELSE current_status END")} AS state FROM gaps)
SELECT 'conflict' AS ledger, id, CASE WHEN flag IN ('true', 'yes', 'y', '1', 'genuine') THEN NOT regexp_matches(st, 'reject|retired') WHEN flag IN ('false', 'no', 'n', '0') THEN false ELSE NOT regexp_matches(st || ' ' || rs, '{_DEAD}|pending') END AS shown FROM cf
UNION ALL SELECT 'finding', id, n > 0 AND NOT (starts_with(ms, 'exclude') OR contains(ms, 'candidate') OR starts_with(ms, 'pending')) AND (starts_with(ms, 'include') OR (NOT (regexp_matches(st, 'retired|demoted|insufficient|superseded|deprecated|candidate') OR starts_with(st, 'pending')) AND NOT (ms = '' AND st = '' AND n < 3))) FROM vf
UNION ALL SELECT 'invalidated', id, st <> '' AND NOT regexp_matches(st || ' ' || rs, '{_DEAD}') AND NOT regexp_matches(st, 'proposed|pending|provisional|unreviewed') FROM ia
UNION ALL SELECT 'complementary', id, contains(st, 'confirm') AND NOT regexp_matches(rs, '{_DEAD}') AND NOT contains(lower(insight), 'may improve robustness and generalisability') AND len(list_filter(string_split_regex(insight, '\\s+'), lambda w: w <> '')) >= 20 FROM co
UNION ALL SELECT 'gap', id, state IN ('open', 'partially_open') FROM gp""",
    "q_since_window": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-15' GROUP BY 1",
}
