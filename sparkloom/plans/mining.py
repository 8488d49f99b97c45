"""Pair mining, ledgers against papers, duplicate scans and registry statistics over the derived world."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coded, detect, metrics, text
from ..operators import aggregates, evidence, extraction, graph, lint, merge, pairs, registry_flow, selection
from .lints import _DEAD, _gaps
from .reports import _t
from .texts import _N, _SCOPE, _SUBHITS, _ladder, _nodes, _tok
from .world import ctes, world


def q_registry_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictions in the registry with every gate, without pairs that the ledger knows and papers that are no evidence."""
    rows = extraction.conflict_inputs(world(spark, sf_dir, "registry"))
    number = lambda c: F.substring(c, 3, 20).cast("int")
    known = world(spark, sf_dir, "conflicts").select(number("paper_a").alias("a_number"), number("paper_b").alias("b_number"))
    flagged = world(spark, sf_dir, "flags").where("flag in ('commentary_editorial', 'not_a_study')").select(F.col("pid").alias("Paper_ID")).distinct()
    found = pairs.registry_conflicts(rows, known, flagged)
    return found.select("a_number", "b_number", "task", "dataset_family", "modality_family", "mtype", F.round("gap", 3).alias("gap"))


def q_consensus_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that may support a claim: long terms in common, one of them an anchor."""
    papers = world(spark, sf_dir, "registry").select(F.col("Paper_ID").alias("pid"), text.tokens(F.col("Key_Novelty")).alias("terms"))
    claims = world(spark, sf_dir, "assumptions").withColumn("n", F.substring("assumption_id", 4, 9).cast("int"))
    words = F.concat(F.lit("compensatory hyperactivation and severity of veterans visiting clinic"), F.col("n").cast("string"))
    claims = claims.select(F.col("assumption_id").alias("claim"), text.tokens(words).alias("terms"), F.array(F.concat(F.lit("P-"), (F.col("n") * 3 + 1).cast("string"))).alias("supporters"))
    anchors = aggregates.anchor_terms(papers, F.col("terms"), "pid").select("term")
    return evidence.consensus_support(papers, claims, anchors)


def q_gap_rechecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = world(spark, sf_dir, "registry").select(F.col("Paper_ID").alias("pid"), coded.task(F.col("Task_Type")).alias("task"), text.tokens(F.col("Key_Novelty")).alias("terms"), (F.col("k") % 3).alias("markers"))
    n = F.col("n_nationkey")
    gaps = _t(spark, sf_dir, "nation").select(F.concat(F.lit("G-"), n.cast("string")).alias("gap"), F.when(n % 4 > 0, F.concat(F.lit("T"), (n % 6 + 1).cast("string"))).alias("task"), text.tokens(F.concat(F.lit("signal of olfactory deficits among farmers visiting predicts clinic"), n.cast("string"))).alias("terms"))
    return evidence.gap_rechecks(papers, gaps).select("gap", "pid", "overlap", F.round("score", 6).alias("score"), F.array_join("terms", ",").alias("terms"))


def q_invalidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = world(spark, sf_dir, "registry").select(F.col("Paper_ID").alias("pid"), metrics.modality_nodes(F.col("Modality")).alias("nodes"), F.concat_ws(" ", "Key_Novelty", "Primary_Limitation").alias("summary"))
    n = F.col("n_nationkey")
    beliefs = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("belief"), F.when(n % 3 == 0, "any").when(n % 3 == 1, "Neuroimaging").alias("scope"), F.array(F.lit("thick"), F.lit("conver"), F.concat(F.lit("clinic"), n.cast("string"))).alias("belief_words"), F.array(F.lit("need"), F.lit("farm")).alias("signal_words"))
    return evidence.invalidations(papers, beliefs)


SIGNALS = """
SELECT 'P-' || CAST(c_custkey + 1 AS STRING) AS pid, 'identifier' AS kind, 'PII:' || CAST(c_custkey * 7 % 1300 AS STRING) || '/' || CAST(c_custkey % 3 AS STRING) AS value FROM {customer}
UNION ALL SELECT 'P-' || CAST(c_custkey + 1 AS STRING), 'map_doi', '10.1/' || CAST(c_custkey * 5 % 1400 AS STRING) FROM {customer}
UNION ALL SELECT 'P-' || CAST(c_custkey + 1 AS STRING), 'doi_field', CASE WHEN c_custkey % 3 > 0 THEN '10.2/' || CAST(c_custkey * 3 % 1420 AS STRING) END FROM {customer}
UNION ALL SELECT 'P-' || CAST(c_custkey + 1 AS STRING), 'title', 'a title that many share ' || CAST(c_custkey * 11 % 1450 AS STRING) FROM {customer}"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SIGNALS, customer=_t(spark, sf_dir, "customer"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs.signal_pairs(_signals(spark, sf_dir), ["title", "doi_field"])
    number = lambda c: F.substring(c, 3, 20).cast("int")
    similarity = F.when(F.get("a_title", F.lit(0)) == F.get("b_title", F.lit(0)), 1.0).when(number("a") % 5 > 0, 0.5)
    p = p.withColumns({"similarity": similarity, "anchored": F.array_contains("kinds", "identifier"), "stubbed": (number("a") % 17 == 0) | (number("b") % 17 == 0), "no_doi": F.col("a_doi_field").isNull() & F.col("b_doi_field").isNull()})
    return graph.classify(p)


def q_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("a", "b", F.array_join("kinds", ",").alias("kinds"), "class")


def q_duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signals(spark, sf_dir)
    blocks = s.groupBy("pid").agg(*[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(n) for k, n in (("doi_field", "doi_field"), ("map_doi", "other_doi"), ("identifier", "identifier"))])
    blocks = blocks.withColumns({c: F.when(F.substring("pid", 3, 20).cast("int") % 6 > 0, F.col(c)) for c in ("other_doi", "identifier")})
    return graph.scan_report(_classified(spark, sf_dir), blocks)


def q_stub_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals of the components of shared identifiers, without those that hold a conflict; and the columns in which members differ."""
    s = _signals(spark, sf_dir)
    c = graph.components(s.select(F.col("pid").alias("node")).distinct(), graph.star_edges(s, ["identifier"]))
    number = F.substring("node", 3, 20).cast("int")
    members = c.select("component", F.col("node").alias("pid"), F.when(number % 31 == 0, F.concat(F.lit("P-"), (number % 9 + 1).cast("string"))).alias("recorded"))
    held = members.where(F.substring("pid", 3, 20).cast("int") % 13 == 0).select("component").distinct()
    plan = graph.stub_plan(members, held)
    coded_rows = members.join(world(spark, sf_dir, "registry").select(F.col("Paper_ID").alias("pid"), "Category", "Task_Type"), "pid")
    return plan.join(graph.disagreements(coded_rows, ["Category", "Task_Type"]), "component", "left").select("component", "pid", "original", F.array_join("columns", ",").alias("columns"))


def q_earlier_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("10.2/"), (F.col("c_custkey") * 3 % 1420).cast("string"))).alias("doi"), text.norm_title(F.concat(F.lit("A title that many papers share "), (F.col("c_custkey") * 11 % 700).cast("string")), "").alias("title"), (F.col("c_custkey") % 29 == 0).alias("stub"))
    return pairs.earlier_copies(s)


def q_known_already(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New files against the corpus by DOI, file name and title."""
    k = F.col("s_suppkey")
    title = lambda c: F.concat(F.lit("deep networks that read "), c, F.lit(" images of older adults in clinics of many towns"))
    files = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), k.cast("string")).alias("file"), F.when(k % 2 == 0, F.concat(F.lit("10.2/"), (k * 40).cast("string"))).alias("doi"), F.concat(F.lit("S"), (k * 9).cast("string")).alias("stem"), title(F.concat(F.lit("type"), (k * 7).cast("string"))).alias("title"))
    c = F.col("c_custkey")
    corpus = _t(spark, sf_dir, "customer").select(F.concat(F.lit("P-"), c.cast("string")).alias("pid"), F.concat(F.lit("10.2/"), (c * 3).cast("string")).alias("doi"), F.concat(F.lit("S"), (c * 5).cast("string")).alias("stem"), F.concat(F.lit("on "), title(F.concat(F.lit("type"), c.cast("string")))).alias("title"))
    return pairs.known_already(files, corpus.select("doi", "pid"), corpus.select(F.concat(F.lit("10.2/"), (F.substring("pid", 3, 9).cast("int") * 5).cast("string")).alias("doi")), corpus.select("stem"), corpus.select("pid", "title"))


def q_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complementary pairs that no group forbids, by a hard relation or within its scope; and strongest relations by kind."""
    members = world(spark, sf_dir, "groups").withColumn("scope", F.array("scope"))
    free = evidence.unblocked(world(spark, sf_dir, "complementary"), members, "paper_a", "paper_b", "combined_insight")
    out = free.groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("paper_a").alias("n_papers"))
    small = _t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.concat(F.lit("S-"), F.col("s_suppkey").cast("string"))).alias("papers"))
    groups = small.select("papers", F.when(F.col("s_nationkey") % 2 == 0, "hard_block").otherwise("single_source").alias("enforcement"), (F.col("s_nationkey") % 5 == 0).alias("retired"))
    kinds = evidence.independence_pairs(groups).groupBy(F.col("enforcement").alias("status")).agg(F.count("*").alias("n"), F.countDistinct("a").alias("n_papers"))
    return out.unionByName(kinds)


def q_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that gaps refer to: known, unknown and repaired in place; ids that no registry row has."""
    g = _gaps(spark, sf_dir).select("id", "claiming")
    valid = coded.included(world(spark, sf_dir, "registry")).select(F.col("Paper_ID").alias("pid"))
    fixed = lint.repair_ids(g, "claiming", valid, "id").select(F.lit("repaired").alias("part"), "id", F.array_join("claiming", ",").alias("refs"))
    lost = evidence.unresolved(g, ["claiming"], valid).select(F.lit("unresolved").alias("part"), F.col("pid").alias("id"), F.lit("").alias("refs"))
    return fixed.unionByName(lost)


def q_next_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _t(spark, sf_dir, "nation").select(F.concat(F.lit("G-CAND-"), F.col("n_nationkey").cast("string")).alias("id"))
    new = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return merge.next_ids(old, new, "id", "G-CAND-", ["c_name", "c_custkey"]).select("id", "c_custkey")


def q_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier-made statement's most similar part record of the same brand."""
    names = F.array(*[F.lit(x) for x in ("small ring", "red widget case", "large blue bolt", "green plate and ring", "steel widget")])
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("p_brand"), text.tokens(F.get(names, (F.col("s_suppkey") % 5).cast("int")), []).alias("tokens"))
    known = _t(spark, sf_dir, "part").select("p_brand", "p_partkey", text.tokens(F.col("p_name"), []).alias("tokens"))
    return selection.best_match(s, known, "p_brand", "tokens", "p_partkey").select("s_suppkey", "match", F.round("similarity", 6).alias("similarity"))


def q_ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = world(spark, sf_dir, "gaps")
    g = g.withColumn("state", evidence.gap_status(F.col("current_status"), F.col("status"))).withColumn("raw", evidence.gap_status(F.col("current_status"), F.col("status"), "status_first"))
    g = g.withColumn("tier2", metrics.gap_tier(F.col("tier"), F.col("gap_type"), F.col("id"), F.col("gap_statement")))
    one = evidence.summary(g, "state", "tier2").select(F.lit("current_first").alias("policy"), F.col("state").alias("status"), F.col("tier2").alias("tier"), "n", "of_status")
    two = evidence.summary(g, "raw", "tier2").select(F.lit("status_first").alias("policy"), F.col("raw").alias("status"), F.col("tier2").alias("tier"), "n", "of_status")
    c = world(spark, sf_dir, "conflicts").withColumn("g", evidence.genuine_conflict(F.col("genuine_conflict"), F.col("status")).cast("string"))
    three = evidence.summary(c.withColumn("kind", F.coalesce("status", F.lit("none"))), "g", "kind").select(F.lit("genuine").alias("policy"), F.col("g").alias("status"), F.col("kind").alias("tier"), "n", "of_status")
    return one.unionByName(two).unionByName(three)


def q_registry_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry_flow.statistics(world(spark, sf_dir, "registry")).select("section", "item", "n", F.round("of", 6).alias("of"), F.round("pct", 6).alias("pct"))


def q_appraisal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry_flow.appraisal(world(spark, sf_dir, "registry"), world(spark, sf_dir, "support").select("pid").distinct())


def q_suspect_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative list of suspect papers: those published before and those of this run."""
    r = world(spark, sf_dir, "registry")
    now = r.where(metrics.suspect(metrics.metric_parse(F.col("Best_Metric")))).select("Paper_ID")
    before = world(spark, sf_dir, "flags").where("flag = 'overlap'").select(F.col("pid").alias("Paper_ID"))
    return registry_flow.flagged(before, now, "Paper_ID")


def q_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = lambda n: world(spark, sf_dir, n)
    return registry_flow.graph_counts(w("registry"), w("findings"), w("support"), w("conflicts"), w("complementary"), _gaps(spark, sf_dir), w("invalidated"))


def q_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method and modality pairs of one task that no row combines, three to a paper."""
    return registry_flow.missing_combinations(world(spark, sf_dir, "registry"))


def q_consensus_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supporters that do not meet a finding's required family or design, queued and never deleted."""
    out = registry_flow.review_queue(registry_flow.with_requirements(world(spark, sf_dir, "findings").withColumnRenamed("required_family", "required_modality_family")), world(spark, sf_dir, "support"), world(spark, sf_dir, "registry"))
    return out.select("id", "n", "queued", "required_modality_family", "required_design", "min_task_hits", F.array_join("queue", ",").alias("queue"))


def q_gap_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy and single-paper gaps: pruned or rejected, protected where a person kept them."""
    return registry_flow.clean_gaps(_gaps(spark, sf_dir)).groupBy("action", "state").agg(F.count("*").alias("n"))


def q_conflict_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts with contradictory flags or gaps below their tiers' threshold, put right."""
    out = registry_flow.consistent(world(spark, sf_dir, "conflicts"), world(spark, sf_dir, "registry"))
    return out.select("id", "genuine", "genuine_conflict", "note")


def q_legacy_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = world(spark, sf_dir, "conflicts").withColumns({"modality_family": F.when(F.col("k") % 2 == 0, "unknown").otherwise("eeg_meg"), "family_equal": F.lit(None).cast("string")})
    return registry_flow.backfill_families(c, world(spark, sf_dir, "registry"), 12).where("family_equal is not null").select("id", "modality_family", "family_equal")


def q_evidence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = world(spark, sf_dir, "registry")
    return r.select("Paper_ID", registry_flow.evidence_text(F.lit("A summary.")).alias("evidence"), registry_flow.complementary_text(F.lit("found"), F.lit("limited")).alias("complementary"))


QUERIES = {
    f.__name__: f
    for f in (
        q_registry_conflicts, q_consensus_support, q_gap_rechecks, q_invalidations, q_duplicate_pairs, q_duplicate_report, q_stub_plan, q_earlier_copies, q_known_already, q_independence, q_references, q_next_ids, q_best_match,
        q_ledger_summary, q_registry_statistics, q_appraisal_counts, q_suspect_flags, q_graph_counts, q_combinations, q_consensus_review, q_gap_cleanup, q_conflict_fixes, q_legacy_families, q_evidence_texts,
    )
}

_W = {n: ctes(n)[5:] for n in ("registry",)}
_V = """n AS (SELECT *, regexp_extract_all(Best_Metric, '\\d+(?:\\.\\d+)?') AS x FROM registry),
m AS (SELECT *, CASE WHEN starts_with(Best_Metric, 'AUC 0.') THEN 'AUC' WHEN starts_with(Best_Metric, 'accuracy') THEN 'ACC' WHEN starts_with(Best_Metric, 'no accuracy') THEN 'HR' WHEN starts_with(Best_Metric, 'F1') THEN 'F1' WHEN contains(Best_Metric, ' AUC (95%') THEN 'AUC' END AS mtype,
  CASE WHEN starts_with(Best_Metric, 'AUC 0.') THEN x[1]::DOUBLE WHEN starts_with(Best_Metric, 'accuracy') THEN x[1]::DOUBLE / 100 WHEN starts_with(Best_Metric, 'no accuracy') THEN x[1]::DOUBLE WHEN starts_with(Best_Metric, 'F1') THEN x[2]::DOUBLE WHEN contains(Best_Metric, ' AUC (95%') THEN 0.95::DOUBLE END AS value FROM n)"""
_CODES = f"""r AS (SELECT *, regexp_extract(Paper_ID, '(\\d+)', 1)::INT AS number, coalesce(nullif(regexp_extract(trim(Task_Type), '^(T[1-6])', 1), ''), 'NR') AS task, coalesce(nullif(regexp_extract(trim(Validation_Type), '^(V[1-4])', 1), ''), 'V2') AS tier,
  {_nodes('lower(trim(Modality))')} AS nodes, {_ladder("lower(trim(Modality || ' ' || Method_Architecture))", metrics.FAMILIES, f"coalesce({_nodes('lower(trim(Modality))')}[1], lower(trim(Modality || ' ' || Method_Architecture)))")} AS modality_family,
  {_ladder('upper(Dataset)', metrics.DATASETS, 'CASE ' + ' '.join(f"WHEN contains(upper(Dataset), '{c}') THEN 'single-centre-{c.strip().lower()}'" for c in metrics.COUNTRIES) + " ELSE 'single-centre' END")} AS dataset_family,
  regexp_replace(lower(trim(modality_subtype)), '[_\\-]+', ' ', 'g') AS st FROM m)"""
_GATE = "('', 'Not reported', 'Not Reported', 'not reported', 'NR', 'N/A')"
_CUT = "CASE {} WHEN 'V1' THEN 0.15 WHEN 'V2' THEN 0.08 WHEN 'V3' THEN 0.05 WHEN 'V4' THEN 0.03 ELSE 0.08 END::DOUBLE"
_T = "regexp_replace(lower(trim(coalesce({}, ''))), '[\\s\\-]+', '_', 'g')"


def _known(c: str) -> str:
    return f"CASE WHEN trim({c}) IN {_GATE} THEN '' ELSE lower(trim({c})) END"


_PAIRS = f"""sg AS ({SIGNALS.format(customer='customer')}),
sp AS (SELECT x.pid AS a, y.pid AS b, list_sort(list(DISTINCT kind)) AS k FROM (SELECT DISTINCT * FROM sg WHERE value IS NOT NULL) x JOIN (SELECT DISTINCT * FROM sg WHERE value IS NOT NULL) y USING (kind, value) WHERE x.pid < y.pid GROUP BY 1, 2),
ti AS (SELECT pid, value AS t FROM sg WHERE kind = 'title'), fd AS (SELECT pid FROM sg WHERE kind = 'doi_field' AND value IS NOT NULL),
sm AS (SELECT a, b, k, CASE WHEN u.t = v.t THEN 1.0 WHEN substr(a, 3)::INT % 5 > 0 THEN 0.5 END AS sim, list_contains(k, 'identifier') AS anchored, substr(a, 3)::INT % 17 = 0 OR substr(b, 3)::INT % 17 = 0 AS stubbed, a NOT IN (SELECT pid FROM fd) AND b NOT IN (SELECT pid FROM fd) AS no_doi
  FROM sp JOIN ti u ON u.pid = a JOIN ti v ON v.pid = b),
cl AS (SELECT a, b, array_to_string(k, ',') AS kinds, no_doi, CASE WHEN stubbed THEN 'duplicate_stubbed' WHEN anchored AND sim >= 0.9 THEN 'duplicate' WHEN anchored AND sim IS NULL THEN 'anchor_unverified' WHEN anchored THEN 'map_conflict' WHEN list_contains(k, 'map_doi') THEN 'map_doi_collision' WHEN list_contains(k, 'doi_field') THEN 'doi_field_collision' ELSE 'title_only_collision' END AS class FROM sm)"""
_LONG = "('longitudinal_multipoint', 'longitudinal_2point', 'future_value_forecasting', 'survival_analysis')"
SQL = {
    "q_registry_conflicts": ctes("registry", "conflicts", "flags") + f""",
{_V}, {_CODES},
u AS (SELECT *, {_known('study_design_type')} AS design, {_known('task_substage')} AS sub, {_known('population_specificity')} AS pop, CASE WHEN lower(trim(modality_subtype)) IN ('', 'not reported', 'unknown', 'none', 'nr') THEN '' WHEN len({_SUBHITS}) > 1 THEN 'multimodal' ELSE coalesce({_SUBHITS}[1], '') END AS bucket, {_CUT.format('tier')} AS cut
  FROM r WHERE trim(Task_Type) NOT IN {_GATE} AND trim(Dataset) NOT IN {_GATE} AND trim(Modality) NOT IN {_GATE} AND trim(Best_Metric) NOT IN {_GATE} AND lower(trim(duplicate_of)) IN ('', 'not reported') AND mtype IN ('AUC', 'ACC', 'F1') AND value <= 0.97 AND task <> 'NR'
  AND Paper_ID NOT IN (SELECT pid FROM flags WHERE flag IN ('commentary_editorial', 'not_a_study')))
SELECT a.number AS a_number, b.number AS b_number, task, dataset_family, modality_family, mtype, round(abs(a.value - b.value), 3) AS gap FROM u a JOIN u b USING (task, dataset_family, modality_family, mtype)
WHERE a.number < b.number AND abs(a.value - b.value) >= greatest(a.cut, b.cut) AND abs(substr(a.tier, 2, 1)::INT - substr(b.tier, 2, 1)::INT) <= 2 AND (a.design = '' OR b.design = '' OR (a.design IN {_LONG}) = (b.design IN {_LONG}))
  AND NOT (a.sub <> '' AND b.sub <> '' AND a.sub <> b.sub) AND (a.sub <> '' OR b.sub <> '') AND NOT (a.pop <> '' AND b.pop <> '' AND a.pop <> b.pop) AND NOT (a.bucket <> '' AND b.bucket <> '' AND a.bucket <> b.bucket)
  AND (a.number, b.number) NOT IN (SELECT (least(substr(paper_a, 3)::INT, substr(paper_b, 3)::INT), greatest(substr(paper_a, 3)::INT, substr(paper_b, 3)::INT)) FROM conflicts)""",
    "q_consensus_support": ctes("registry", "assumptions") + f""",
p AS (SELECT Paper_ID AS pid, unnest({_tok('Key_Novelty')}) AS term FROM registry), n AS (SELECT count(*) AS n FROM registry),
an AS (SELECT term FROM p GROUP BY 1 HAVING count(*) <= greatest(3, floor(0.03 * (SELECT n FROM n))) AND (length(term) >= 7 OR contains(term, '-'))),
c AS (SELECT assumption_id AS claim, unnest({_tok("'compensatory hyperactivation and severity of veterans visiting clinic' || substr(assumption_id, 4)")}) AS term, 'P-' || (substr(assumption_id, 4)::INT * 3 + 1)::VARCHAR AS own FROM assumptions),
l AS (SELECT *, term IN (SELECT term FROM an) AS anchor FROM c WHERE length(term) >= 6), z AS (SELECT claim, count(*) AS size, bool_or(anchor) AS has FROM l GROUP BY 1),
h AS (SELECT claim, pid, any_value(own) AS own, count(*) AS shared, max(anchor::INT) AS anchored FROM l JOIN p USING (term) WHERE length(term) >= 6 GROUP BY 1, 2)
SELECT claim, pid, shared, anchored::INT AS anchored FROM h JOIN z USING (claim) WHERE shared >= least(2, size) AND (NOT has OR anchored = 1) AND pid <> own""",
    "q_gap_rechecks": ctes("registry") + f""",
p AS (SELECT Paper_ID AS pid, coalesce(nullif(regexp_extract(trim(Task_Type), '^(T[1-6])', 1), ''), 'NR') AS task, {_tok('Key_Novelty')} AS w FROM registry WHERE k % 3 >= 1),
g AS (SELECT 'G-' || n_nationkey::VARCHAR AS gap, CASE WHEN n_nationkey % 4 > 0 THEN 'T' || (n_nationkey % 6 + 1)::VARCHAR END AS task, {_tok("'signal of olfactory deficits among farmers visiting predicts clinic' || n_nationkey::VARCHAR")} AS w FROM nation),
x AS (SELECT gap, pid, list_sort(list_intersect(p.w, g.w)) AS met, len(g.w) AS size FROM p JOIN g ON g.task IS NULL OR g.task = p.task)
SELECT gap, pid, len(met)::BIGINT AS overlap, round(len(met)::DOUBLE / size, 6) AS score, array_to_string(met[1:10], ',') AS terms FROM x WHERE len(met) >= 5 AND len(met)::DOUBLE / size >= 0.15""",
    "q_invalidations": ctes("registry") + f""",
p AS (SELECT Paper_ID AS pid, {_nodes('lower(trim(Modality))')} AS nodes, lower(Key_Novelty || ' ' || Primary_Limitation) AS low FROM registry),
b AS (SELECT n_name AS belief, CASE n_nationkey % 3 WHEN 0 THEN 'any' WHEN 1 THEN 'Neuroimaging' END AS scope, ['thick', 'conver', 'clinic' || n_nationkey::VARCHAR] AS bw, ['need', 'farm'] AS sw FROM nation),
x AS (SELECT belief, pid, scope, nodes, len(list_filter(bw, lambda w: contains(low, w)))::INT AS belief_hits, len(list_filter(sw, lambda w: contains(low, w)))::INT AS signal_hits FROM p, b)
SELECT belief, pid, belief_hits, signal_hits FROM x WHERE (scope IS NULL OR scope = 'any' OR list_contains(nodes, scope)) AND belief_hits >= 2 AND signal_hits >= 1""",
    "q_independence": ctes("groups", "complementary") + """,
f AS (SELECT status, paper_a FROM complementary c WHERE NOT EXISTS (SELECT 1 FROM groups a JOIN groups b ON a.gid = b.gid AND a.pid <> b.pid WHERE NOT a.retired AND a.pid = c.paper_a AND b.pid = c.paper_b AND (a.enforcement = 'hard_block' OR (a.enforcement = 'scope_limited' AND a.scope <> 'all' AND contains(lower(coalesce(c.combined_insight, '')), lower(a.scope)))))),
p AS (SELECT 'S-' || a.s_suppkey::VARCHAR AS x, 'S-' || b.s_suppkey::VARCHAR AS y, a.s_nationkey AS n FROM supplier a JOIN supplier b USING (s_nationkey) WHERE 'S-' || a.s_suppkey::VARCHAR < 'S-' || b.s_suppkey::VARCHAR AND s_nationkey % 5 <> 0)
SELECT status, count(*) AS n, count(DISTINCT paper_a) AS n_papers FROM f GROUP BY 1 UNION ALL SELECT CASE WHEN n % 2 = 0 THEN 'hard_block' ELSE 'single_source' END, count(*), count(DISTINCT x) FROM p GROUP BY 1""",
    "q_references": ctes("registry", "gaps") + f""",
v AS (SELECT Paper_ID FROM registry WHERE {_SCOPE})
SELECT 'repaired' AS part, id, CASE WHEN claim1 IN (SELECT Paper_ID FROM v) THEN claim1 ELSE 'UNRESOLVED' END || CASE WHEN claim2 IS NULL THEN '' WHEN claim2 IN (SELECT Paper_ID FROM v) THEN ',' || claim2 ELSE ',UNRESOLVED' END AS refs FROM gaps
UNION ALL SELECT 'unresolved', pid, '' FROM (SELECT DISTINCT pid FROM (SELECT claim1 AS pid FROM gaps UNION ALL SELECT claim2 FROM gaps) WHERE pid IS NOT NULL AND pid NOT IN (SELECT Paper_ID FROM v))""",
    "q_next_ids": "SELECT 'G-CAND-' || (24 + row_number() OVER (ORDER BY c_name, c_custkey))::VARCHAR AS id, c_custkey FROM customer",
    "q_best_match": r"""
WITH s AS (SELECT s_suppkey, 'Brand#' || (s_suppkey % 25 + 1)::VARCHAR AS p_brand, list_distinct(regexp_extract_all(['small ring', 'red widget case', 'large blue bolt', 'green plate and ring', 'steel widget'][s_suppkey % 5 + 1], '[a-z][a-z0-9\-]{2,}')) AS w FROM supplier),
k AS (SELECT p_brand, p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z][a-z0-9\-]{2,}')) AS v FROM part), j AS (SELECT s_suppkey, p_partkey, len(list_intersect(w, v))::DOUBLE / len(list_distinct(w || v)) AS similarity FROM s JOIN k USING (p_brand))
SELECT s_suppkey, p_partkey AS match, round(similarity, 6) AS similarity FROM j WHERE similarity >= 0.35 QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY similarity DESC, p_partkey) = 1""",
    "q_earlier_copies": """
WITH s AS (SELECT c_custkey AS pid, CASE WHEN c_custkey % 3 > 0 THEN '10.2/' || (c_custkey * 3 % 1420)::VARCHAR END AS doi, 'atitlethatmanypapersshare' || (c_custkey * 11 % 700)::VARCHAR AS title FROM customer WHERE c_custkey % 29 <> 0),
m AS (SELECT pid, title, CASE WHEN doi IS NOT NULL THEN min(pid) OVER (PARTITION BY doi) END AS d, min(pid) OVER (PARTITION BY title) AS t FROM s)
SELECT pid, CASE WHEN d < pid THEN d ELSE t END AS original, CASE WHEN d < pid THEN 'same DOI' ELSE 'same title' END AS reason FROM m WHERE d < pid OR (t < pid AND length(title) > 25)""",
    "q_known_already": """
WITH f AS (SELECT 'f' || s_suppkey::VARCHAR AS file, CASE WHEN s_suppkey % 2 = 0 THEN '10.2/' || (s_suppkey * 40)::VARCHAR END AS doi, 'S' || (s_suppkey * 9)::VARCHAR AS stem, 'deep networks that read type' || (s_suppkey * 7)::VARCHAR || ' images of older adults in clinics of many towns' AS title FROM supplier),
c AS (SELECT 'P-' || c_custkey::VARCHAR AS pid, '10.2/' || (c_custkey * 3)::VARCHAR AS doi, '10.2/' || (c_custkey * 5)::VARCHAR AS prose, 'S' || (c_custkey * 5)::VARCHAR AS stem, 'on deep networks that read type' || c_custkey::VARCHAR || ' images of older adults in clinics of many towns' AS title FROM customer),
r AS (SELECT file, (SELECT string_agg(pid, ',' ORDER BY pid) FROM c WHERE c.doi = f.doi) AS owners, EXISTS (SELECT 1 FROM c WHERE c.prose = f.doi) AS p, EXISTS (SELECT 1 FROM c WHERE c.stem = f.stem) AS n, (SELECT min(pid) FROM c WHERE contains(c.title, substr(f.title, 1, 70)) OR contains(f.title, substr(c.title, 1, 70))) AS t FROM f),
x AS (SELECT file, list_filter([CASE WHEN owners IS NOT NULL THEN 'doi-field=' || owners END, CASE WHEN owners IS NULL AND p THEN 'doi-in-prose' END, CASE WHEN n THEN 'filename' END, CASE WHEN t IS NOT NULL THEN 'title=' || t END], lambda v: v IS NOT NULL) AS reasons FROM r)
SELECT file, CASE WHEN len(reasons) > 0 THEN 'DUP' ELSE 'NEW' END AS verdict, array_to_string(reasons, '; ') AS reasons FROM x""",
    "q_suspect_flags": ctes("registry", "flags") + f",\n{_V} SELECT Paper_ID FROM m WHERE mtype IN ('AUC', 'ACC', 'F1') AND value > 0.97 UNION SELECT pid FROM flags WHERE flag = 'overlap'",
    "q_legacy_families": ctes("registry", "conflicts") + f""",
{_V}, {_CODES}
SELECT c.id, CASE WHEN c.k % 2 = 0 THEN CASE WHEN a.modality_family = b.modality_family THEN a.modality_family ELSE a.modality_family || '|' || b.modality_family END ELSE 'eeg_meg' END AS modality_family, CASE WHEN a.modality_family = b.modality_family THEN 'Yes' ELSE 'No' END AS family_equal
FROM conflicts c JOIN r a ON a.Paper_ID = paper_a JOIN r b ON b.Paper_ID = paper_b WHERE c.k BETWEEN 1 AND 12""",
    "q_evidence_texts": ctes("registry") + """
SELECT Paper_ID, concat_ws(' ', Paper_ID, nullif(Category, ''), nullif(Modality, ''), nullif(Method_Architecture, ''), nullif(Task_Type, ''), nullif(Best_Metric, ''), nullif(Validation_Type, ''), Key_Novelty, Primary_Limitation, nullif(Architecture_Family, ''), nullif(XAI_Method, ''), 'A summary.') AS evidence,
  concat_ws(' ', Paper_ID, Task_Type, Modality, Key_Novelty, 'found', 'limited') AS complementary FROM registry""",
    "q_conflict_fixes": ctes("registry", "conflicts") + f""",
j AS (SELECT c.*, lower(trim(coalesce(genuine, ''))) AS one, lower(trim(coalesce(genuine_conflict, ''))) AS two, greatest({_CUT.format("coalesce(a.Validation_Type, 'V2')")}, {_CUT.format("coalesce(b.Validation_Type, 'V2')")}) AS least FROM conflicts c LEFT JOIN registry a ON a.Paper_ID = paper_a LEFT JOIN registry b ON b.Paper_ID = paper_b),
x AS (SELECT *, (one IN ('no', 'false') AND two = 'true') OR (one IN ('yes', 'true') AND two = 'false') AS bad, gap_magnitude < least AS small FROM j)
SELECT id, CASE WHEN bad OR small THEN 'No' ELSE genuine END AS genuine, CASE WHEN bad OR small THEN 'false' ELSE genuine_conflict END AS genuine_conflict,
  concat_ws(' ', CASE WHEN bad THEN '[contradictory flags]' END, CASE WHEN small THEN printf('[gap %.3f below threshold %.3f]', gap_magnitude, least) END) AS note FROM x""",
    "q_gap_cleanup": ctes("gaps") + f""",
s AS (SELECT *, lower(trim(coalesce(nullif(current_status, ''), nullif(status, ''), ''))) AS state, claim2 IS NULL AS single FROM gaps),
a AS (SELECT *, CASE WHEN (gap_type = 'combinatorial' OR tier = 'combinatorial') AND human_note IS NULL AND (gap_statement = '' OR regexp_matches(gap_statement, '{registry_flow.POINTER}') OR regexp_matches(gap_statement, '{registry_flow.NO_COMBINATION}')) THEN 'pruned'
  WHEN state IN ('candidate', 'open') AND human_note IS NULL AND closure_criteria = '{registry_flow.LIMITATION_CLOSURE}' AND single THEN 'rejected' ELSE 'kept' END AS action FROM s)
SELECT action, CASE WHEN action = 'rejected' THEN 'rejected' ELSE state END AS state, count(*) AS n FROM a GROUP BY 1, 2""",
    "q_duplicate_pairs": "WITH " + _PAIRS + " SELECT a, b, kinds, class FROM cl",
    "q_duplicate_report": "WITH " + _PAIRS + """,
bl AS (SELECT 'P-' || (c_custkey + 1)::VARCHAR AS pid, c_custkey % 3 = 0 AS none, (c_custkey + 1) % 6 > 0 AS seen FROM customer)
SELECT 'blocks' AS measure, count(*) AS n FROM bl UNION ALL SELECT 'without_doi_field', count(*) FROM bl WHERE none UNION ALL SELECT 'covered_otherwise', count(*) FROM bl WHERE none AND seen UNION ALL SELECT 'no_signal', count(*) FROM bl WHERE none AND NOT seen
UNION ALL SELECT 'pairs', count(*) FROM cl UNION ALL SELECT 'open_duplicates', count(*) FROM cl WHERE class = 'duplicate' UNION ALL SELECT 'invisible_by_doi', count(*) FROM cl WHERE class IN ('duplicate', 'map_conflict') AND no_doi
UNION ALL SELECT 'open_duplicate_rows', count(DISTINCT pid) FROM (SELECT a AS pid FROM cl WHERE class = 'duplicate' UNION ALL SELECT b FROM cl WHERE class = 'duplicate') UNION ALL SELECT 'class:' || class, count(*) FROM cl GROUP BY 1""",
    "q_stub_plan": ctes("registry") + """,
m AS (SELECT k, Paper_ID AS pid, Category, Task_Type, min(Paper_ID) OVER w AS component FROM registry WINDOW w AS (PARTITION BY k * 7 % 1300, k % 3)),
l AS (SELECT component, coalesce(min(CASE WHEN (k + 1) % 31 = 0 THEN 'P-' || ((k + 1) % 9 + 1)::VARCHAR END), arg_min(pid, k)) AS original, bool_or((k + 1) % 13 = 0) AS held,
  array_to_string(list_filter([CASE WHEN count(DISTINCT Category) > 1 THEN 'Category' END, CASE WHEN count(DISTINCT Task_Type) > 1 THEN 'Task_Type' END], lambda v: v IS NOT NULL), ',') AS columns FROM m GROUP BY 1)
SELECT component, pid, original, columns FROM m JOIN l USING (component) WHERE NOT held AND pid <> original""",
    "q_ledger_summary": ctes("gaps", "conflicts") + """,
g AS (SELECT *, CASE WHEN lower(trim(coalesce(tier, ''))) IN ('curated', 'derived', 'combinatorial', 'structural') THEN lower(trim(tier)) WHEN gap_type = 'combinatorial' THEN 'combinatorial' WHEN gap_type IN ('structural_absence', 'underrepresentation') THEN 'structural'
    WHEN gap_type = 'candidate' OR starts_with(lower(gap_statement), 'limitation-derived gap') OR starts_with(lower(id), 'g-cand') THEN 'derived' ELSE 'curated' END AS t,
  lower(coalesce(nullif(current_status, ''), nullif(status, ''))) AS c1, lower(coalesce(nullif(status, ''), nullif(current_status, ''), 'missing')) AS s1 FROM gaps),
a AS (SELECT 'current_first' AS policy, CASE WHEN c1 IN ('open', 'partially_open', 'closed', 'candidate') THEN c1 ELSE 'open' END AS status, t AS tier FROM g UNION ALL SELECT 'status_first', s1, t FROM g
  UNION ALL SELECT 'genuine', (CASE WHEN lower(genuine_conflict) IN ('true', 'yes') THEN true WHEN lower(genuine_conflict) IN ('false', 'no') THEN false ELSE coalesce(contains(status, 'confirm'), false) END)::VARCHAR, coalesce(status, 'none') FROM conflicts)
SELECT policy, status, tier, count(*) AS n, (sum(count(*)) OVER (PARTITION BY policy, status))::BIGINT AS of_status FROM a GROUP BY 1, 2, 3""",
    "q_registry_statistics": ctes("registry") + f""",
s AS (SELECT *, regexp_replace(trim(Sample_N_Approx), ',', '', 'g') AS sn, try_cast(nullif(regexp_extract(Publication_Year, '(\\d{{4}})', 1), '') AS INT) AS y FROM registry WHERE {_SCOPE}),
d AS (SELECT *, coalesce(nullif(regexp_extract(trim(Validation_Type), '^(V[1-4])', 1), ''), 'NR') AS tier, coalesce(nullif(regexp_extract(trim(Task_Type), '^(T[1-6])', 1), ''), 'NR') AS task, CASE WHEN y IS NULL THEN 'undated' WHEN y < 2021 THEN 'early' ELSE y::VARCHAR END AS bucket,
  CASE WHEN upper(trim(Category)) IN ('C1', 'C2', 'C3', 'C4', 'C5', 'C6') THEN upper(trim(Category)) ELSE 'OTHER' END AS domain, CASE WHEN starts_with(lower(trim(study_design_type)), 'longitudinal') THEN 'longitudinal' ELSE lower(trim(study_design_type)) END AS design, trim(Architecture_Family) AS arch,
  lower(trim(XAI_Method)) NOT IN ('', 'not reported', 'none', 'n/a', 'not applicable') AS xai, lower(trim(ADNI_Dependent)) = 'true' AS adni,
  CASE WHEN NOT regexp_matches(regexp_extract(sn, {_N}, 2), '(?i)^(?:stud(?:y|ies)|papers?|articles?|publications?|trials?|rcts|records?|reviews|experts|datasets|cohorts)') AND try_cast(nullif(regexp_extract(sn, {_N}, 1), '') AS DOUBLE) > 0 THEN try_cast(regexp_extract(sn, {_N}, 1) AS DOUBLE) END AS size FROM s),
c AS (SELECT * FROM d WHERE task IN ('T1', 'T2', 'T3')), n AS (SELECT count(*) AS n FROM d),
sh AS (SELECT 'tier_by_year' AS section, bucket || '|' || tier AS item, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY bucket)::DOUBLE AS of FROM d GROUP BY bucket, tier
  UNION ALL SELECT 'tier', tier, count(*), (SELECT n FROM n) FROM d GROUP BY 2 UNION ALL SELECT 'classification_tier', tier, count(*), (SELECT count(*) FROM c) FROM c GROUP BY 2 UNION ALL SELECT 'task', task, count(*), (SELECT n FROM n) FROM d GROUP BY 2
  UNION ALL SELECT 'domain', domain, count(*), (SELECT n FROM n) FROM d GROUP BY 2 UNION ALL SELECT 'design', design, count(*), (SELECT n FROM n) FROM d GROUP BY 2 UNION ALL SELECT 'arch', arch, count(*), (SELECT n FROM n) FROM d GROUP BY 2
  UNION ALL SELECT 'domain_by_task', domain || '|' || task, count(*), (SELECT n FROM n) FROM d GROUP BY 2
  UNION ALL SELECT 'adni', 'corpus', count(*) FILTER (adni), count(*) FROM d UNION ALL SELECT 'adni', 'classification', count(*) FILTER (adni), count(*) FROM c UNION ALL SELECT 'xai', 'corpus', count(*) FILTER (xai), count(*) FROM d UNION ALL SELECT 'xai', 'classification', count(*) FILTER (xai), count(*) FROM c
  UNION ALL SELECT 'deep_by_year', y::VARCHAR, count(*) FILTER (arch IN ('A2', 'A3', 'A4', 'A5', 'A7')), count(*) FROM d WHERE y BETWEEN 2021 AND 2026 GROUP BY 2 UNION ALL SELECT 'v4_by_year', y::VARCHAR, count(*) FILTER (tier = 'V4'), count(*) FROM c WHERE y BETWEEN 2021 AND 2026 GROUP BY 2
  UNION ALL SELECT 'in_window', 'corpus', count(*) FILTER (y BETWEEN 2021 AND 2026), count(*) FROM d UNION ALL SELECT 'default_tier', CASE WHEN task = 'T6' THEN 'T6' ELSE 'RCT' END, count(*) FILTER (tier = 'V2'), count(*) FROM d WHERE task = 'T6' OR design = 'randomized_controlled_trial' GROUP BY 2),
dup AS (SELECT *, trim(coalesce(duplicate_of, '')) NOT IN ('', 'not reported') AS copy, regexp_matches(lower(Modality), 'out[-_]of[-_]scope') AS oos FROM registry),
pl AS (SELECT 'rows' AS section, 'all' AS item, count(*)::DOUBLE AS n FROM dup UNION ALL SELECT 'rows', 'copies', count(*) FROM dup WHERE copy UNION ALL SELECT 'rows', 'copies_of_papers', count(*) FROM dup WHERE copy AND regexp_matches(trim(duplicate_of), '^P-\\d+') UNION ALL SELECT 'rows', 'out_of_scope', count(*) FROM dup WHERE NOT copy AND oos
  UNION ALL SELECT 'rows', 'included', count(*) FROM dup WHERE NOT copy AND NOT oos UNION ALL SELECT 'sample_n', 'usable', count(size) FROM d UNION ALL SELECT 'sample_n', 'q25', quantile_cont(size, 0.25) FROM d UNION ALL SELECT 'sample_n', 'median', quantile_cont(size, 0.5) FROM d UNION ALL SELECT 'sample_n', 'q75', quantile_cont(size, 0.75) FROM d)
SELECT section, item, n, round(of, 6) AS of, round(100.0 * n / of, 6) AS pct FROM sh UNION ALL SELECT section, item, n, NULL::DOUBLE, NULL::DOUBLE FROM pl""",
    "q_appraisal_counts": ctes("registry", "support") + f""",
n AS (SELECT *, regexp_extract_all(Best_Metric, '\\d+(?:\\.\\d+)?') AS x FROM registry WHERE {_SCOPE} AND Paper_ID IN (SELECT pid FROM support)),
v AS (SELECT *, CASE WHEN starts_with(Best_Metric, 'AUC 0.') THEN x[1]::DOUBLE WHEN starts_with(Best_Metric, 'accuracy') THEN x[1]::DOUBLE / 100 WHEN starts_with(Best_Metric, 'F1') THEN x[2]::DOUBLE WHEN contains(Best_Metric, ' AUC (95%') THEN x[1]::DOUBLE END AS best, starts_with(upper(trim(Validation_Type)), 'V4') AS e FROM n)
SELECT CASE {' '.join(f"WHEN regexp_matches(lower(study_design_type), '{p}') THEN '{i}'" for i, p in detect.INSTRUMENTS)} ELSE 'not assigned (design not coded)' END AS instrument, count(*) AS n, count(*) FILTER (e) AS external, count(*) FILTER (lower(trim(ADNI_Dependent)) IN ('yes', 'true', '1')) AS adni, count(*) FILTER (best >= 0.97 AND NOT e) AS suspect FROM v GROUP BY 1""",
    "q_graph_counts": ctes("registry", "findings", "support", "conflicts", "complementary", "gaps", "invalidated") + f""",
f AS (SELECT f.id, coalesce(n, 0) AS n, {_T.format('manuscript_status')} AS ms, {_T.format('status')} AS st FROM findings f LEFT JOIN (SELECT id, count(*) AS n FROM support GROUP BY 1) USING (id)),
fs AS (SELECT *, n > 0 AND NOT (starts_with(ms, 'exclude') OR contains(ms, 'candidate') OR starts_with(ms, 'pending')) AND (starts_with(ms, 'include') OR (NOT (regexp_matches(st, 'retired|demoted|insufficient|superseded|deprecated|candidate') OR starts_with(st, 'pending')) AND NOT (ms = '' AND st = '' AND n < 3))) AS shown FROM f),
cf AS (SELECT lower(trim(coalesce(nullif(genuine_conflict, ''), genuine, ''))) AS flag, {_T.format('status')} AS st, {_T.format('resolution_status')} AS rs FROM conflicts),
gp AS (SELECT {_T.format("CASE WHEN coalesce(status, '') <> '' THEN status ELSE current_status END")} AS state FROM gaps),
ia AS (SELECT {_T.format('status')} AS st, {_T.format('review_status')} AS rs FROM invalidated)
SELECT 'papers' AS entity, count(*) AS n, 100.0::DOUBLE * count(*) FILTER (lower(trim(ADNI_Dependent)) = 'true') / count(*) AS detail FROM registry
UNION ALL SELECT 'categories', count(DISTINCT c), NULL FROM (SELECT unnest(regexp_extract_all(upper(Category), '\\bC[1-6]\\b')) AS c FROM registry)
UNION ALL SELECT 'findings', count(*) FILTER (shown), avg(n) FILTER (shown) FROM fs
UNION ALL SELECT 'conflicts', count(*), count(*) FILTER (CASE WHEN flag IN ('true', 'yes', 'y', '1', 'genuine') THEN NOT regexp_matches(st, 'reject|retired') WHEN flag IN ('false', 'no', 'n', '0') THEN false ELSE NOT regexp_matches(st || ' ' || rs, '{_DEAD}|pending') END) FROM cf
UNION ALL SELECT 'complementary', count(*) FILTER (contains({_T.format('status')}, 'confirm') AND NOT regexp_matches({_T.format('review_status')}, '{_DEAD}')), NULL FROM complementary
UNION ALL SELECT 'gaps', count(*) FILTER (state IN ('open', 'partially_open')), count(*) FILTER (state = 'open') FROM gp
UNION ALL SELECT 'invalidated', count(*) FILTER (st <> '' AND NOT regexp_matches(st || ' ' || rs, '{_DEAD}') AND NOT regexp_matches(st, 'proposed|pending|provisional|unreviewed')), NULL FROM ia""",
    "q_combinations": ctes("registry") + f""",
d AS (SELECT Paper_ID, k, trim(Task_Type) AS task, lower(trim(Method_Architecture)) AS me, lower(trim(Modality)) AS mo, {_nodes('lower(trim(Modality))')} AS nodes FROM registry),
x AS (SELECT a.Paper_ID, b.Paper_ID AS other, b.k, a.task FROM d a JOIN d b USING (task) WHERE len(a.nodes) > 0 AND len(b.nodes) > 0 AND NOT list_has_any(a.nodes, b.nodes)
  AND NOT (a.me <> '' AND EXISTS (SELECT 1 FROM (SELECT DISTINCT task, me, mo FROM d) r WHERE r.task = a.task AND contains(r.me, a.me) AND contains(r.mo, b.mo))) AND NOT (b.me <> '' AND EXISTS (SELECT 1 FROM (SELECT DISTINCT task, me, mo FROM d) r WHERE r.task = a.task AND contains(r.me, b.me) AND contains(r.mo, a.mo))))
SELECT Paper_ID, other, task FROM x QUALIFY row_number() OVER (PARTITION BY Paper_ID ORDER BY k) <= 3""",
    "q_consensus_review": ctes("registry", "findings", "support") + f""",
f AS (SELECT id, CASE id WHEN 'VF-13' THEN 'retinal' ELSE required_family END AS fam, CASE WHEN required_design = '' OR id = 'VF-13' THEN 'any' ELSE required_design END AS des FROM findings),
p AS (SELECT *, lower(trim(Modality || ' ' || Method_Architecture)) AS t, {_nodes('lower(trim(Modality))')} AS nodes, lower(concat_ws(' ', Paper_ID, Category, Modality, Method_Architecture, Task_Type, Best_Metric, Validation_Type, Key_Novelty, Primary_Limitation, Architecture_Family, XAI_Method)) AS ev FROM registry),
e AS (SELECT s.id, s.pid, p.Paper_ID IS NOT NULL AND (CASE fam WHEN 'any' THEN true WHEN 'novel_family' THEN true
    WHEN 'multimodal' THEN regexp_matches(t, '{'|'.join(registry_flow.FUSION)}') OR ({' + '.join(f"regexp_matches(t, '{'|'.join(w)}')::INT" for _, w in metrics.FAMILIES)}) >= 2
    WHEN 'functional_mri' THEN regexp_matches(t, '{'|'.join(registry_flow.FAMILY_MARKERS['functional_mri'])}') WHEN 'retinal' THEN regexp_matches(t, '{'|'.join(registry_flow.FAMILY_MARKERS['retinal'])}') WHEN 'graph_nn' THEN regexp_matches(t, '{'|'.join(registry_flow.FAMILY_MARKERS['graph_nn'])}')
    WHEN 'clinical_population' THEN regexp_matches(t, '{'|'.join(registry_flow.FAMILY_MARKERS['clinical_population'])}') WHEN 'eeg_meg' THEN {_ladder('t', metrics.FAMILIES, f"coalesce(nodes[1], t)")} = 'eeg_meg' END)
    AND (des <> 'longitudinal' OR upper(trim(Validation_Type)) IN ('V3', 'V4') OR regexp_matches(ev, '{'|'.join(registry_flow.DESIGN_MARKERS)}')) AS fits
  FROM support s JOIN f USING (id) LEFT JOIN p ON p.Paper_ID = s.pid),
q AS (SELECT id, count(*) AS n, count(*) FILTER (NOT coalesce(fits, false)) AS queued, string_agg(pid, ',' ORDER BY pid) FILTER (NOT coalesce(fits, false)) AS queue FROM e GROUP BY 1)
SELECT id, coalesce(n, 0) AS n, coalesce(queued, 0) AS queued, fam AS required_modality_family, des AS required_design, 5 AS min_task_hits, coalesce(queue, '') AS queue FROM f LEFT JOIN q USING (id)""",
}
