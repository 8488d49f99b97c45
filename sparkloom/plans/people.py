"""Cohort operators over customers as people: orders are visits, their statuses states, their priorities raw codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import cohort, estimators, lint, registry_rules
from ..operators import longitudinal as lon
from ..operators import reports as tables
from .lints import _gaps
from .mining import _T
from .reports import _t
from .world import ctes, world

STATES = {"O": 1, "P": 2, "F": 3}


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their day written in three spellings, their state, and a QC mark."""
    k = F.col("o_orderkey")
    day = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 3 == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    state = F.lit(None).cast("int")
    for s, n in STATES.items():
        state = F.when(F.col("o_orderstatus") == s, n).otherwise(state)
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), k.alias("visit"), F.when(k % 50 > 0, day).otherwise("unknown").alias("written"), state.alias("s"), F.substring("o_orderpriority", 1, 1).cast("int").alias("raw"), F.when(k % 40 == 1, " Yes ").when(k % 40 == 2, "1.0").otherwise("0").alias("qc"))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.valid_visits(_orders(spark, sf_dir), "person", cohort.date(F.col("written")), F.col("s"), F.col("qc"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _valid(spark, sf_dir).withColumn("first", F.min("day").over(Window.partitionBy("person")))
    return cohort.trajectories(v, "person", F.col("day") == F.col("first"))


def q_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elapsed years and states of each person's days from the baseline on, days with several states aside."""
    return _paths(spark, sf_dir).select("person", F.round("t", 9).alias("t"), "state")


def q_qc_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _orders(spark, sf_dir)
    return d.groupBy(cohort.failed_qc(F.col("qc")).alias("by_text"), cohort.failed_qc(F.col("qc"), "number").alias("by_number"), cohort.recoded(F.col("raw")).alias("recoded")).agg(F.count("*").alias("n"))


def q_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident people after a baseline in the first state, and converters with a raw code in between."""
    p = _paths(spark, sf_dir).withColumn("raw", F.col("state"))
    a = cohort.incident_summary(p, "person", 2.0)
    return a.crossJoin(cohort.between_events(p, "person", 1, 5.0)).withColumn("median_follow_up", F.round("median_follow_up", 9))  # one row each


def q_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of three columns, nulls too; people and rows by stage of a source audit."""
    d = _orders(spark, sf_dir).withColumn("raw", F.when(F.col("raw") < 4, F.col("raw")))
    f = cohort.frequency(d, "raw", "qc", "s").select("column", "value", "n", F.lit(None).cast("bigint").alias("people"))
    stages = {"all": F.lit(True), "dated": cohort.date(F.col("written")).isNotNull(), "passed": ~cohort.failed_qc(F.col("qc")), "coded": F.col("raw") > 1}
    a = cohort.audit(d, "person", stages)
    return f.unionByName(a.select(F.lit("audit").alias("column"), F.col("stage").alias("value"), F.col("rows").alias("n"), "people"))


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", (F.col("c_nationkey") + 45 + k % 50).alias("age"), F.when(k % 11 > 0, F.when(k % 2 == 0, 1).otherwise(2)).alias("sex"), (k % 25).alias("education"), F.when(k % 5 > 0, F.concat((k % 3 + 2).cast("string"), F.lit("/"), (k % 4 + 1).cast("string"))).alias("genotype"), F.when(k % 7 > 1, (k % 2).cast("int")).alias("tobacco"),
    )


def q_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived covariates, outcomes within a horizon and phase dummies of every customer."""
    d = cohort.covariates(_covered(spark, sf_dir), "age", "sex", 2, "education", "genotype")
    event = F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") % 60) / 10.0)
    time, hit = cohort.outcome(event, (F.col("c_custkey") % 80) / 10.0, 4.0)
    d, names = cohort.dummies(d.withColumns({"time": time, "event": hit}), "c_mktsegment")
    r = lambda c: F.round(c, 9).alias(c)
    return d.select("c_custkey", r("age10"), r("age10_sq"), "female", r("educ4"), "e4", r("time"), "event", *[F.col(f"`{n}`").alias(n.lower()) for n in names])


def q_covariate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness over people of nations that have both smokers and others."""
    d = _covered(spark, sf_dir).withColumn("centre", F.concat_ws("-", "c_mktsegment", (F.col("age") % 40).cast("string"))).na.drop(subset=["tobacco"])
    own = cohort.with_support(d, "centre", "tobacco")
    return cohort.covariate_counts(own, F.col("age"), F.col("sex"), F.col("education"), F.substring("genotype", 1, 1).cast("int"), F.col("tobacco"))


def q_first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidence of the first state away from the baseline's at three horizons."""
    p = _paths(spark, sf_dir)
    start = p.where("t = 0 and state = 2").select("person")
    events = lon.first_events(p.join(start, "person", "left_semi"), "person", "t", "state", 2).withColumn("time", F.round("time", 9))
    out = lon.at_horizons(lon.cumulative_incidence(events), cohort.HORIZONS)
    return out.select("event", *[F.round(c, 9).alias(c) for c in out.columns if c != "event"])


def q_visit_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cohort.visit_gaps(_paths(spark, sf_dir), "person")
    return out.select("people", "within_400", "within_548", *[F.round(c, 6).alias(c) for c in ("q25", "median", "q75")])


def q_schedule_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct shares under schedules of two periods, with and without an offset, two windows; and up to a common endpoint."""
    p = _paths(spark, sf_dir)
    grid = cohort.grid_sensitivity(p, "person", (1.0, 2.0), (0.25, 0.5))
    sub = cohort.direct_metrics(cohort.endpoint_subset(p, "person", 3.0, 0.5), "person").select(F.lit(0.0).alias("period"), F.lit(3.0).alias("offset"), F.lit(0.5).alias("window"), "n", "n_direct", "share")
    return grid.unionByName(sub).select("period", "offset", "window", "n", "n_direct", F.round("share", 9).alias("share"))


def q_masked_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct shares of the full series and of two masked ones."""
    m = cohort.masked(_paths(spark, sf_dir), "person", [("one", 1.0, 0.25), ("two", 2.0, 0.5)])
    first = m.groupBy("schedule").agg(F.count("*").alias("visits"), F.countDistinct("person").alias("people"))
    full = cohort.direct_metrics(m.where("schedule = 'full'"), "person").select(F.lit("full").alias("schedule"), "n", "n_direct")
    two = cohort.direct_metrics(m.where("schedule = 'two'"), "person").select(F.lit("two").alias("schedule"), "n", "n_direct")
    return first.join(full.unionByName(two), "schedule", "left").select("schedule", "visits", "people", "n", "n_direct")


def q_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-form transition chances of three states for rates made of parts."""
    p = _t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    m = stats.ctmc((k % 7 + 1) / 50.0, (k % 5) / 200.0, (k % 11 + 1) / 60.0, (k % 3 + 1) / 40.0, F.col("p_size") / 10.0)
    return p.select("p_partkey", m.alias("m")).select("p_partkey", *[F.round(F.col("m")[c], 9).alias(c) for c in ("p11", "p12", "p13", "p21", "p22", "p23")])


def q_study_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules of follow-ups, predictive values at set prevalences, and drops between protocols, as one long table."""
    s = cohort.schedules(spark, [6, 12, 24, 48, 72]).select(F.lit("schedule").alias("part"), F.col("interval").cast("string").alias("key"), F.col("follow_ups").alias("value"), F.col("n").cast("double").alias("x"))
    n = _t(spark, sf_dir, "nation")
    g = cohort.prevalence_grid(n.select(F.col("n_name").alias("name"), (0.5 + F.col("n_nationkey") / 60.0).alias("sens"), (0.6 + F.col("n_regionkey") / 20.0).alias("spec")), (0.05, 0.2, 0.5))
    g = g.select(F.lit("prevalence").alias("part"), F.concat_ws("@", "name", F.col("prevalence").cast("string")).alias("key"), F.lit("ppv").alias("value"), F.round("ppv", 9).alias("x"))
    e = cohort.evidence_differences(n.select("n_name", (90.0 + F.col("n_nationkey") / 10.0).alias("loose"), (60.0 + F.col("n_regionkey")).alias("strict")), "n_name", "strict", "loose")
    return s.unionByName(g).unionByName(e.select(F.lit("difference").alias("part"), F.col("n_name").alias("key"), F.lit("").alias("value"), F.col("difference").alias("x")))


def q_selection_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stabilised, winsorised weights of selected customers, scaled to mean one."""
    d = _t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 3 == 0).alias("selected"), (0.05 + (F.col("c_custkey") % 90) / 100.0).alias("p"))
    return estimators.selection_weights(d, "p", "selected").select("c_custkey", F.round("weight", 9).alias("weight"))


def q_integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tables lack of their expected values, files of their manifest, and two results of each other."""
    n = _t(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("region"), F.concat(F.lit("seen by "), "n_name").alias("note"))
    expected = _t(spark, sf_dir, "nation").select("n_name", F.explode(F.array(F.struct(F.lit("region").alias("field"), F.lit("2.0").alias("value"), F.lit("equals").alias("how")), F.struct(F.lit("note").alias("field"), F.lit("NATION_1").alias("value"), F.lit("contains").alias("how")), F.struct(F.lit("region").alias("field"), F.lit("").alias("value"), F.lit("empty").alias("how")))).alias("e")).select("n_name", "e.*")
    a = lint.unexpected(n, "n_name", expected).select(F.lit("expected").alias("part"), F.col("n_name").alias("key"), F.concat_ws("/", "field", "expected", "found").alias("detail"))
    p = _t(spark, sf_dir, "pages")
    files = p.select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content")).dropDuplicates(["path"])
    manifest = p.groupBy(F.col("url").alias("path")).agg(F.min("page_id").alias("i")).select(F.when(F.col("i") % 9 == 0, F.concat(F.lit("gone/"), "path")).otherwise(F.col("path")).alias("path"), F.sha2(F.when(F.col("i") % 4 == 0, "changed").otherwise("same"), 256).alias("sha256"))
    m = lint.off_manifest(files, manifest).groupBy("reason").agg(F.count("*").alias("n")).select(F.lit("manifest").alias("part"), F.col("reason").alias("key"), F.col("n").cast("string").alias("detail"))
    x = _t(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("value"))
    y = _t(spark, sf_dir, "supplier").where("s_acctbal > 1000").select(F.col("s_name").alias("name"), (F.col("s_acctbal") + F.when(F.col("s_suppkey") % 5 == 0, 0.5).otherwise(0.0)).alias("value"))
    d = lint.disagreeing(x, y, "name", "value", 0.1).select(F.lit("results").alias("part"), F.col("name").alias("key"), F.when(F.col("b").isNull(), "missing").otherwise("differs").alias("detail"))
    return a.unionByName(m).unionByName(d)


# tables


def q_matrix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.category_task_matrix(world(spark, sf_dir, "registry"))


def q_profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.profile(world(spark, sf_dir, "registry"))


def q_appendix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = tables.appendix(world(spark, sf_dir, "registry"))
    hub = tables.hub_narrative(world(spark, sf_dir, "registry"))
    return a.join(hub, "Paper_ID")


def q_ledger_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the five ledger tables as (table, id, text)."""
    w = lambda n: world(spark, sf_dir, n)
    editorial = spark.createDataFrame([("CF-E1", "P-1", "P-2", "an editor's own words")], "id string, paper_a string, paper_b string, combined_insight string")
    shown = tables.complementary_table(w("complementary"), editorial)
    fallback = tables.complementary_table(w("complementary"), editorial, few=1_000_000_000)
    parts = [
        tables.findings_table(w("findings"), w("support")).select(F.lit("findings").alias("table"), "id", F.concat_ws(" # ", "statement", "papers").alias("text")),
        tables.conflicts_table(w("conflicts")).select(F.lit("conflicts").alias("table"), "id", F.concat_ws(" # ", "claims", "genuine").alias("text")),
        shown.select(F.lit("complementary").alias("table"), "id", "insight"), fallback.select(F.lit("editorial").alias("table"), "id", "insight"),
        tables.gaps_table(_gaps(spark, sf_dir)).select(F.lit("gaps").alias("table"), "id", F.concat_ws(" # ", "statement", "claiming", "state")),
        tables.invalidated_table(w("invalidated"), w("assumptions")).select(F.lit("invalidated").alias("table"), "id", F.concat_ws(" # ", "belief", "paper")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def q_markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown table of frequencies, most common first; and the difference of two result tables."""
    from ..operators import registry_flow

    common = registry_flow.most_common(_t(spark, sf_dir, "part"), "p_brand").withColumn("rank", -F.col("n"))
    lines = tables.markdown(common, ["p_brand", "n"], ["Brand", "Parts"], ["rank", "p_brand"])
    s = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    t = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("n"))
    diff = tables.difference_report(s, t, "c_nationkey", "n")
    return lines.unionByName(diff.select((F.col("c_nationkey") + 1000).cast("bigint").alias("line_no"), F.concat_ws("/", F.col("a").cast("int").cast("string"), F.col("b").cast("int").cast("string"), F.col("difference").cast("int").cast("string")).alias("line")))


SUBTYPES = ("EEG_spectral", "structural_MRI_only", "plasma_biomarkers", "not reported")


def q_lint_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of every registry row against its vocabulary and a block made for it."""
    r = world(spark, sf_dir, "registry").withColumn("Journal", F.repeat(F.lit("x"), (F.col("k") % 130).cast("int")))
    k = F.col("k")
    blocks = r.where("Method_Architecture <> ''").select(
        F.col("Paper_ID").alias("pid"), F.when(k % 25 == 0, "[STUB - excluded]").otherwise("A title").alias("title"), F.concat(F.lit("uses shap and Lime; AUC 0."), (50 + k % 50).cast("string"), F.lit(" for MCI versus controls")).alias("body"), F.concat(F.lit("T"), (k % 4 + 1).cast("string"), F.lit(" coded")).alias("task"),
        F.concat(F.lit("V"), (k % 4 + 1).cast("string")).alias("tier"), F.when(k % 2 == 0, "A1").alias("arch"), F.lit("C5 first").alias("category"), F.concat(F.lit("n = 1,"), (100 + k % 900).cast("string")).alias("n_line"), F.concat(F.lit("in "), (2016 + k % 11).cast("string")).alias("year"), F.when(k % 3 > 0, "Yes").otherwise("false").alias("adni"),
    )
    copies = r.where("startswith(duplicate_of, 'P-')").select(F.col("Paper_ID").alias("pid"), F.lit("P-1").alias("original"))
    return registry_rules.registry_rules(r, blocks, copies, SUBTYPES)


def q_rewrite_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    body = F.concat(F.lit("### A\n"), F.when(k % 3 > 0, "### B\n").otherwise(""), F.when(k % 7 == 0, "The text is a placeholder").otherwise("fine"))
    novelty = F.when(k % 5 == 0, "Contents lists available here").when(k % 5 == 1, F.repeat(F.lit("long "), 30)).otherwise("new")
    out = registry_rules.rewrite_reasons(body, ("### A", "### B"), novelty, F.concat(F.lit("Year "), (1970 + k % 70).cast("string")), 2026, "is a placeholder")
    return _t(spark, sf_dir, "orders").groupBy(F.array_join(out, ",").alias("reasons")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        q_trajectories, q_qc_policies, q_incidence, q_frequencies, q_covariates, q_covariate_counts, q_first_events, q_visit_gaps, q_schedule_grid, q_masked_shares, q_kernel, q_study_tables, q_selection_weights, q_integrity_checks,
        q_matrix_table, q_profile_table, q_appendix_table, q_ledger_tables, q_markdown_lines, q_lint_registry, q_rewrite_reasons,
    )
}

_O = """o AS (SELECT o_custkey AS person, o_orderkey AS k, o_orderdate::DATE AS day, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 WHEN 'F' THEN 3 END AS s, substr(o_orderpriority, 1, 1)::INT AS raw, CASE WHEN o_orderkey % 40 = 1 THEN ' Yes ' WHEN o_orderkey % 40 = 2 THEN '1.0' ELSE '0' END AS qc FROM orders)"""
_P = "WITH " + _O + """,
v AS (SELECT *, min(day) OVER (PARTITION BY person) AS first FROM o WHERE k % 50 > 0 AND s IS NOT NULL AND k % 40 <> 1),
c AS (SELECT person, day, min(s) AS state, any_value(first) AS first FROM v GROUP BY 1, 2 HAVING min(s) = max(s)), b AS (SELECT person, day AS day0 FROM c WHERE day = first),
p AS (SELECT person, date_diff('day', day0, day) / 365.25::DOUBLE AS t, state FROM c JOIN b USING (person) WHERE day >= day0)"""
_DIRECT = "SELECT {0}, count(*) AS n, count(*) FILTER (m IS NULL OR m >= e) AS n_direct FROM (SELECT {1}person, min(t) FILTER (state = 2) AS m, min(t) FILTER (state = 3) AS e FROM {2} GROUP BY ALL) WHERE e IS NOT NULL"


def _mask(period: float, window: float, offset: float, source: str = "p") -> str:
    start = offset or period
    return f"""(WITH l AS (SELECT *, max(t) OVER (PARTITION BY person) AS last FROM {source}), g AS (SELECT *, {start}::DOUBLE + unnest(range(0, 20)) * {period}::DOUBLE AS target FROM l),
n AS (SELECT person, t, state FROM g WHERE t > 0 AND target <= last + {window}::DOUBLE + 1e-8 AND abs(t - target) <= {window}::DOUBLE QUALIFY row_number() OVER (PARTITION BY person, target ORDER BY abs(t - target), t) = 1)
SELECT person, t, state FROM n UNION SELECT person, t, state FROM l WHERE t = 0 OR t = last)"""


def _grid() -> str:
    rows = [(p, o, w) for p in (1.0, 2.0) for o in (0.0, p / 2) for w in (0.25, 0.5)]
    parts = [f"SELECT {p}::DOUBLE AS period, {o}::DOUBLE AS \"offset\", {w}::DOUBLE AS \"window\", n, n_direct, round(n_direct::DOUBLE / n, 9) AS share FROM ({_DIRECT.format('1 AS one', '', _mask(p, w, o))})" for p, o, w in rows]
    sub = "(SELECT p.* FROM p JOIN (SELECT person, arg_min(t, struct_pack(d := abs(t - 3.0), t := t)) AS e FROM p WHERE abs(t - 3.0) <= 0.5 GROUP BY 1) x USING (person) WHERE t <= e)"
    parts.append(f"SELECT 0.0::DOUBLE, 3.0::DOUBLE, 0.5::DOUBLE, n, n_direct, round(n_direct::DOUBLE / n, 9) FROM ({_DIRECT.format('1 AS one', '', sub)})")
    return " UNION ALL ".join(parts)


_CELL = "CASE WHEN trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g')) = '' THEN '{1}' ELSE replace(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '|', '/') END"
_SHORT = "CASE WHEN length(trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))) <= {1} THEN trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g')) ELSE rtrim(substr(trim(regexp_replace({0}, '\\s+', ' ', 'g')), 1, {1} - 3)) || '...' END"
_NAV = "('NA', 'N/A', 'not reported', 'not_reported', 'NR', '')"
_DEADRX = "rejected|demoted|retired|insufficient|superseded|deprecated|invalid|candidate|awaiting"


def _cov(x: str) -> str:
    return f"SELECT c_custkey, c_mktsegment, c_nationkey + 45 + c_custkey % 50 AS age, CASE WHEN c_custkey % 11 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END END AS sex, c_custkey % 25 AS education, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 3 + 2 END AS g1, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 4 + 1 END AS g2, CASE WHEN c_custkey % 7 > 1 THEN c_custkey % 2 END AS tobacco FROM customer{x}"


def _lint_sql() -> str:
    hard = {f"{c} outside enum": f"trim({c}) NOT IN {_NAV} AND NOT regexp_matches(trim({c}), '^(?:{p})$')" for c, p in registry_rules.CODES.items() if c != "Category"}
    hard["Category outside enum"] = f"len(list_filter(list_transform(string_split(Category, ','), lambda v: trim(v)), lambda v: v NOT IN {_NAV} AND NOT regexp_matches(v, '^C[1-6]$'))) > 0"
    hard["XAI_Method outside enum"] = f"trim(XAI_Method) NOT IN {_NAV} AND trim(XAI_Method) NOT IN ({', '.join(repr(x) for x in registry_rules.XAI)})"
    hard["ADNI_Dependent outside enum"] = "lower(trim(ADNI_Dependent)) NOT IN ('true', 'false', 'na', 'not reported', '')"
    for c, v in (("Task_Type", "b_task"), ("Validation_Type", "b_tier"), ("Architecture_Family", "b_arch"), ("Category", "'C5'")):
        hard[f"{c} disagrees with block"] = f"block AND coalesce({v}, '') <> '' AND trim({c}) NOT IN {_NAV} AND NOT contains(trim({c}), {v})"
    hard["Publication_Year disagrees with block"] = "block AND substr(trim(Publication_Year), 1, 4) <> b_year"
    hard["ADNI_Dependent disagrees with block"] = "block AND lower(trim(ADNI_Dependent)) IN ('true', 'false') AND (k % 3 > 0) <> (lower(trim(ADNI_Dependent)) = 'true')"
    hard["XAI_Method never mentioned"] = "block AND trim(XAI_Method) NOT IN ('none', 'NA', '', 'not reported', 'SHAP', 'LIME')"
    hard["duplicate of an earlier block"] = "starts_with(duplicate_of, 'P-') AND NOT stub"
    soft = {f"{c} out of vocabulary": f"trim({c}) <> '' AND trim({c}) NOT IN {_NAV} AND trim({c}) NOT IN ({', '.join(repr(x) for x in v)})" for c, v in (("study_design_type", registry_rules.DESIGNS), ("primary_metric_type", registry_rules.METRIC_TYPES), ("modality_subtype", SUBTYPES))}
    soft |= {f"{c} out of vocabulary": f"trim({c}) <> '' AND trim({c}) NOT IN ({', '.join(repr(x) for x in v)})" for c, v in (("population_specificity", registry_rules.POPULATIONS), ("task_substage", registry_rules.SUBSTAGES))}
    soft["Modality prose"] = "length(Modality) > 80"
    soft["Best_Metric prose"] = "length(Best_Metric) > 200"
    soft["Journal prose"] = "k % 130 > 120"
    soft["Modality holds justification"] = "regexp_matches(Modality, '(?i)\\*\\*|codebook|assignment')"
    soft["Best_AUC not a bare number"] = f"trim(Best_AUC) NOT IN {_NAV} AND NOT regexp_matches(trim(Best_AUC), '^0?\\.\\d+$|^1(?:\\.0+)?$|^0\\.\\d+\\s*[-/]\\s*0\\.\\d+')"
    soft["Best_AUC provenance"] = "block AND trim(Task_Type) = 'T2' AND starts_with(Best_AUC, '0.')"
    soft["Sample_N differs from block"] = "block AND regexp_extract(Sample_N_Approx, '\\d[\\d,]*') <> '' AND replace(regexp_extract(Sample_N_Approx, '\\d[\\d,]*'), ',', '') <> '1' || (100 + k % 900)::VARCHAR"
    from .lints import _found

    return ctes("registry") + """,
j AS (SELECT *, Paper_ID AS id, k % 25 = 0 AND Method_Architecture <> '' AS stub, Method_Architecture <> '' AND k % 25 <> 0 AS block, 'T' || (k % 4 + 1)::VARCHAR AS b_task, 'V' || (k % 4 + 1)::VARCHAR AS b_tier, CASE WHEN k % 2 = 0 THEN 'A1' END AS b_arch, (2016 + k % 11)::VARCHAR AS b_year FROM registry)
""" + _found(hard, soft, "j")


SQL = {
    "q_trajectories": _P + " SELECT person, round(t, 9) AS t, state FROM p",
    "q_qc_policies": "WITH " + _O + " SELECT k % 40 = 1 AS by_text, k % 40 = 2 AS by_number, CASE raw WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 END AS recoded, count(*) AS n FROM o GROUP BY 1, 2, 3",
    "q_incidence": _P + """,
s AS (SELECT person FROM p WHERE t = 0 GROUP BY 1 HAVING min(state) = 1), f AS (SELECT s.person, min(t) FILTER (state = 2 AND t > 0) AS m, min(t) FILTER (state = 3 AND t > 0) AS e, max(t) FILTER (t > 0) AS l FROM s JOIN p USING (person) GROUP BY 1),
i AS (SELECT *, m IS NOT NULL AND (e IS NULL OR m < e) AS inc FROM f), d AS (SELECT *, m IS NULL OR m > e AS direct, EXISTS (SELECT 1 FROM p WHERE p.person = f.person AND state = 1 AND t > 0 AND t < e) AS seen FROM f WHERE e <= 5)
SELECT (SELECT count(*) FROM i) AS baseline, (SELECT count(*) FROM i WHERE inc) AS incident, (SELECT count(*) FROM i WHERE inc AND e > m) AS later_end, (SELECT count(*) FROM i WHERE inc AND e > m AND e - m <= 2) AS end_within, (SELECT count(*) FROM i WHERE inc AND l > m) AS followed, (SELECT count(*) FROM i WHERE inc AND l <= m) AS not_followed,
  (SELECT round(quantile_cont(l - m, 0.5), 9) FROM i WHERE inc AND l > m) AS median_follow_up, (SELECT count(*) FROM d) AS converters, (SELECT count(*) FROM d WHERE direct) AS direct, (SELECT count(*) FROM d WHERE direct AND seen) AS direct_with_code""",
    "q_frequencies": "WITH " + _O + """, r AS (SELECT *, CASE WHEN raw < 4 THEN raw END AS r3 FROM o)
SELECT 'raw' AS "column", r3::VARCHAR AS value, count(*) AS n, NULL::BIGINT AS people FROM r GROUP BY 2 UNION ALL SELECT 'qc', qc, count(*), NULL FROM r GROUP BY 2 UNION ALL SELECT 's', s::VARCHAR, count(*), NULL FROM r GROUP BY 2 UNION ALL SELECT 'audit', 'all', count(*), count(DISTINCT person) FROM r
UNION ALL SELECT 'audit', 'dated', count(*), count(DISTINCT person) FROM r WHERE k % 50 > 0 UNION ALL SELECT 'audit', 'passed', count(*), count(DISTINCT person) FROM r WHERE k % 50 > 0 AND k % 40 <> 1 UNION ALL SELECT 'audit', 'coded', count(*), count(DISTINCT person) FROM r WHERE k % 50 > 0 AND k % 40 <> 1 AND r3 > 1""",
    "q_covariates": f"""WITH c AS ({_cov('')}), e AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 60) / 10.0::DOUBLE END AS ev, (c_custkey % 80) / 10.0::DOUBLE AS fu FROM c)
SELECT c_custkey, round((age - 75) / 10.0::DOUBLE, 9) AS age10, round(((age - 75) / 10.0::DOUBLE) ** 2, 9) AS age10_sq, (sex = 2)::INT AS female, round((education - 16) / 4.0::DOUBLE, 9) AS educ4, (g1 = 4 OR g2 = 4)::INT AS e4,
  round(CASE WHEN ev > 0 AND ev <= 4 THEN ev ELSE least(fu, 4.0) END, 9) AS time, coalesce(ev > 0 AND ev <= 4, false)::INT AS event, {', '.join(f"(c_mktsegment = '{m}')::INT::DOUBLE AS c_mktsegment_{m.lower()}" for m in ('BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))} FROM e""",
    "q_covariate_counts": f"""WITH c AS (SELECT *, c_mktsegment || '-' || (age % 40)::VARCHAR AS centre FROM ({_cov('')}) WHERE tobacco IS NOT NULL), s AS (SELECT centre FROM c GROUP BY 1 HAVING min(tobacco) <> max(tobacco)),
d AS (SELECT *, coalesce(age BETWEEN 50 AND 120 AND sex IN (1, 2) AND education BETWEEN 0 AND 36, false) AS ok, coalesce(g1 BETWEEN 1 AND 6, false) AS g, coalesce(tobacco IN (0, 1), false) AS t FROM c WHERE centre IN (SELECT centre FROM s))
SELECT count(*) AS people, count(*) FILTER (ok) AS common, count(*) FILTER (ok AND g) AS with_genotype, count(*) FILTER (ok AND t) AS with_smoking, count(*) FILTER (ok AND g AND t) AS with_both FROM d""",
    "q_first_events": _P + """,
s AS (SELECT person FROM p WHERE t = 0 AND state = 2), r AS (SELECT round(coalesce(min(t) FILTER (state <> 2), max(t)), 9) AS t, arg_min(state, t) FILTER (state <> 2) AS event FROM p JOIN s USING (person) GROUP BY person),
by_t AS (SELECT t, count(*)::DOUBLE AS n, count(event)::DOUBLE AS d FROM r GROUP BY 1), k AS (SELECT t, d, sum(n) OVER (ORDER BY t DESC) AS risk FROM by_t), l AS (SELECT *, CASE WHEN d < risk THEN ln(1 - d / risk) ELSE -1e9 END AS lg FROM k),
f AS (SELECT t, risk, coalesce(exp(sum(lg) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0) AS free FROM l), st AS (SELECT r.t, r.event, any_value(free) * count(*) / any_value(risk) AS step FROM r JOIN f ON f.t = r.t WHERE event IS NOT NULL GROUP BY 1, 2)
SELECT event, round(coalesce(sum(step) FILTER (t <= 2), 0), 9) AS h2, round(coalesce(sum(step) FILTER (t <= 4), 0), 9) AS h4, round(coalesce(sum(step) FILTER (t <= 8), 0), 9) AS h8 FROM st GROUP BY 1""",
    "q_visit_gaps": _P + """, g AS (SELECT person, (t - lag(t) OVER (PARTITION BY person ORDER BY t)) * 365.25 AS gap FROM p), m AS (SELECT person, max(gap) AS m FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT (SELECT count(*) FROM m) AS people, (SELECT count(*) FROM m WHERE m <= 400) AS within_400, (SELECT count(*) FROM m WHERE m <= 548) AS within_548, round(quantile_cont(gap, 0.25), 6) AS q25, round(quantile_cont(gap, 0.5), 6) AS median, round(quantile_cont(gap, 0.75), 6) AS q75 FROM g WHERE gap IS NOT NULL""",
    "q_schedule_grid": _P + " " + _grid(),
    "q_masked_shares": _P + f""", m AS (SELECT 'full' AS schedule, * FROM p UNION ALL SELECT 'one', * FROM {_mask(1.0, 0.25, 0.0)} UNION ALL SELECT 'two', * FROM {_mask(2.0, 0.5, 0.0)}),
d AS ({_DIRECT.format('schedule', 'schedule, ', 'm')} AND schedule <> 'one' GROUP BY 1)
SELECT schedule, visits, people, n, n_direct FROM (SELECT schedule, count(*) AS visits, count(DISTINCT person) AS people FROM m GROUP BY 1) LEFT JOIN d USING (schedule)""",
    "q_kernel": """
WITH r AS (SELECT p_partkey, (p_partkey % 7 + 1) / 50.0::DOUBLE AS a, (p_partkey % 5) / 200.0::DOUBLE AS b, (p_partkey % 11 + 1) / 60.0::DOUBLE AS c, (p_partkey % 3 + 1) / 40.0::DOUBLE AS d, p_size / 10.0::DOUBLE AS t FROM part),
e AS (SELECT *, (-(a + b) - (c + d)) / 2 AS mid, sqrt((a + b - c - d) * (a + b - c - d) / 4 + a * c) AS s FROM r), l AS (SELECT *, exp((mid + s) * t) AS e1, exp((mid - s) * t) AS e2 FROM e),
x AS (SELECT *, ((mid + s + c + d) * e1 - (mid - s + c + d) * e2) / (2 * s) AS p11, a * (e1 - e2) / (2 * s) AS p12, c * (e1 - e2) / (2 * s) AS p21, ((mid + s + a + b) * e1 - (mid - s + a + b) * e2) / (2 * s) AS p22 FROM l)
SELECT p_partkey, round(p11, 9) AS p11, round(p12, 9) AS p12, round(1 - p11 - p12, 9) AS p13, round(p21, 9) AS p21, round(p22, 9) AS p22, round(1 - p21 - p22, 9) AS p23 FROM x""",
    "q_study_tables": """
WITH s AS (SELECT i, list_filter([6, 12, 18, 24, 30, 36, 42, 48, 54, 60], lambda m: m % i = 0) AS v FROM (VALUES (6), (12), (24), (48), (72)) t(i)),
n AS (SELECT n_name, 0.5 + n_nationkey / 60.0::DOUBLE AS se, 0.6 + n_regionkey / 20.0::DOUBLE AS sp FROM nation)
SELECT 'schedule' AS part, i::VARCHAR AS key, array_to_string(v, ';') AS value, len(v)::DOUBLE AS x FROM s UNION ALL SELECT 'prevalence', n_name || '@' || p, 'ppv', round(se * p::DOUBLE / (se * p::DOUBLE + (1 - sp) * (1 - p::DOUBLE)), 9) FROM n, (VALUES ('0.05'), ('0.2'), ('0.5')) t(p)
UNION ALL SELECT 'difference', n_name, '', round(90.0 + n_nationkey / 10.0 - 60.0 - n_regionkey, 2)::DOUBLE FROM nation""",
    "q_selection_weights": """
WITH d AS (SELECT c_custkey, c_custkey % 3 = 0 AS s, 0.05::DOUBLE + (c_custkey % 90) / 100.0::DOUBLE AS p FROM customer), r AS (SELECT c_custkey, (SELECT avg(s::INT) FROM d) / p AS w FROM d WHERE s),
q AS (SELECT quantile_cont(w, 0.01) AS lo, quantile_cont(w, 0.99) AS hi FROM r), c AS (SELECT c_custkey, least(greatest(w, lo), hi) AS w FROM r, q) SELECT c_custkey, round(w / (SELECT avg(w) FROM c), 9) AS weight FROM c""",
    "q_integrity_checks": """
WITH u AS (SELECT url, min(page_id) AS i, any_value(html) AS h FROM pages GROUP BY 1)
SELECT 'expected' AS part, n_name AS key, 'region/2.0/' || n_regionkey::VARCHAR AS detail FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'expected', n_name, 'note/NATION_1/seen by ' || n_name FROM nation WHERE NOT contains(n_name, 'NATION_1') UNION ALL SELECT 'expected', n_name, 'region//' || n_regionkey::VARCHAR FROM nation
UNION ALL SELECT 'manifest', CASE WHEN i % 9 = 0 THEN 'missing' ELSE 'digest differs' END, count(*)::VARCHAR FROM u GROUP BY 2
UNION ALL SELECT 'results', s_name, CASE WHEN s_acctbal <= 1000 THEN 'missing' ELSE 'differs' END FROM supplier WHERE s_acctbal <= 1000 OR s_suppkey % 5 = 0""",
    "q_matrix_table": ctes("registry") + """,
d AS (SELECT coalesce(nullif(regexp_extract(trim(Task_Type), '^(T[1-6])', 1), ''), 'NR') AS task, list_distinct(list_filter(list_transform(string_split(upper(Category), '/'), lambda v: trim(v)), lambda v: v IN ('C1', 'C2', 'C3', 'C4', 'C5', 'C6'))) AS codes FROM registry),
x AS (SELECT task, unnest(CASE WHEN len(codes) = 0 THEN ['uncoded'] ELSE codes END) AS category FROM d UNION ALL SELECT task, 'all' FROM d)
SELECT category, count(*) FILTER (task = 'T1') AS t1, count(*) FILTER (task = 'T2') AS t2, count(*) FILTER (task = 'T3') AS t3, count(*) FILTER (task = 'T4') AS t4, count(*) FILTER (task = 'T5') AS t5, count(*) FILTER (task = 'T6') AS t6, count(*) AS total FROM x GROUP BY 1""",
    "q_profile_table": ctes("registry") + """,
d AS (SELECT coalesce(nullif(regexp_extract(upper(trim(Validation_Type)), '^(V[1-4])', 1), ''), 'NR') AS tier, CASE WHEN lower(trim(ADNI_Dependent)) = 'true' THEN 'dependent' ELSE 'independent' END AS adni, CASE WHEN trim(Architecture_Family) IN ('A1', 'A2', 'A3', 'A4', 'A5', 'A6', 'A7', 'A8') THEN trim(Architecture_Family) ELSE 'Other' END AS arch, lower(trim(XAI_Method)) IN ('', 'not reported', 'none', 'n/a', 'not applicable') AS nox FROM registry),
x AS (SELECT 'tier' AS axis, tier AS value FROM d UNION ALL SELECT 'dataset', adni FROM d UNION ALL SELECT 'architecture', arch FROM d UNION ALL SELECT 'architecture with XAI', arch FROM d WHERE NOT nox)
SELECT axis, value, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM d) AS pct FROM x GROUP BY 1, 2""",
    "q_appendix_table": ctes("registry") + f"""
SELECT Paper_ID, {_CELL.format('Category', 'NR')} AS category, {_CELL.format('Task_Type', 'NR')} AS task, substr({_CELL.format('Best_Metric', 'NR')}, 1, 32) AS metric, {_CELL.format('Validation_Type', 'NR')} AS tier, array_to_string(string_split({_CELL.format('Key_Novelty', 'NR')}, ' ')[1:12], ' ') AS novelty,
  '**Paper selected:** ' || Paper_ID || '. Task: ' || {_CELL.format('Task_Type', 'not reported')} || '; best metric: ' || {_CELL.format('Best_Metric', 'not reported')} || '; validation: ' || {_CELL.format('Validation_Type', 'not reported')} || '.' || chr(10) || chr(10) || '**What is the key contribution?**' || chr(10) || chr(10) || {_CELL.format('Key_Novelty', 'not reported')} || chr(10) || chr(10)
  || '**What are the limitations?**' || chr(10) || chr(10) || {_CELL.format('Primary_Limitation', 'not reported')} || chr(10) || chr(10) || '**Which method and data?**' || chr(10) || chr(10) || {_CELL.format('Method_Architecture', 'not reported')} AS section FROM registry""",
    "q_ledger_tables": ctes("findings", "support", "conflicts", "complementary", "gaps", "invalidated", "assumptions") + f""",
s AS (SELECT id, count(*) AS n, string_agg(pid, ', ' ORDER BY substr(pid, 3)::INT) AS papers, array_to_string(list(pid ORDER BY substr(pid, 3)::INT)[1:8], ', ') AS eight FROM support GROUP BY 1),
f AS (SELECT f.*, coalesce(n, 0) AS n, papers, eight, {_T.format('manuscript_status')} AS ms, {_T.format('status')} AS st FROM findings f LEFT JOIN s USING (id)),
cf AS (SELECT *, lower(trim(coalesce(nullif(genuine_conflict, ''), genuine, ''))) AS flag, {_T.format('status')} AS st, {_T.format('resolution_status')} AS rs, lower(trim(coalesce(genuine, genuine_conflict))) AS g FROM conflicts),
co AS (SELECT * FROM complementary WHERE contains({_T.format('status')}, 'confirm') AND NOT regexp_matches({_T.format('review_status')}, '{_DEADRX}') AND NOT contains(lower(coalesce(combined_insight, '')), 'may improve robustness and generalisability') AND len(list_filter(string_split_regex(trim(coalesce(combined_insight, '')), '\\s+'), lambda w: w <> '')) >= 20 ORDER BY k, id LIMIT 10),
gp AS (SELECT *, {_T.format("CASE WHEN coalesce(status, '') <> '' THEN status ELSE current_status END")} AS state FROM gaps),
ia AS (SELECT *, {_T.format('status')} AS st, {_T.format('review_status')} AS rs FROM invalidated)
SELECT 'findings' AS "table", id, {_SHORT.format('statement', 120)} || ' # ' || CASE WHEN n > 10 THEN eight || ' ... and N=' || (n - 8)::VARCHAR || ' additional' ELSE papers END AS text FROM f WHERE n > 0 AND NOT (starts_with(ms, 'exclude') OR contains(ms, 'candidate') OR starts_with(ms, 'pending')) AND (starts_with(ms, 'include') OR (NOT (regexp_matches(st, 'retired|demoted|insufficient|superseded|deprecated|candidate') OR starts_with(st, 'pending')) AND NOT (ms = '' AND st = '' AND n < 3)))
UNION ALL SELECT 'conflicts', id, '**' || paper_a || ':** ' || coalesce(claim_a, '') || ' <br> **' || paper_b || ':** ' || coalesce(claim_b, '') || ' # ' || CASE WHEN g IN ('true', 'yes', '1') THEN 'Yes' WHEN g IN ('false', 'no', '0') THEN 'No' ELSE 'NR' END FROM cf
  WHERE CASE WHEN flag IN ('true', 'yes', 'y', '1', 'genuine') THEN NOT regexp_matches(st, 'reject|retired') WHEN flag IN ('false', 'no', 'n', '0') THEN false ELSE NOT regexp_matches(st || ' ' || rs, '{_DEADRX}|pending') END
UNION ALL SELECT 'complementary', id, {_SHORT.format('combined_insight', 200)} FROM co WHERE (SELECT count(*) FROM co) >= 5 UNION ALL SELECT 'complementary', 'CF-E1', 'an editor''s own words' WHERE (SELECT count(*) FROM co) < 5 UNION ALL SELECT 'editorial', 'CF-E1', 'an editor''s own words'
UNION ALL SELECT 'gaps', id, {_SHORT.format('gap_statement', 120)} || ' # ' || claim1 || coalesce(', ' || claim2, '') || ' # ' || state FROM gp WHERE state IN ('open', 'partially_open')
UNION ALL SELECT 'invalidated', id, coalesce(belief, '') || ' # ' || paper_id FROM ia LEFT JOIN assumptions USING (assumption_id) WHERE st <> '' AND NOT regexp_matches(st || ' ' || rs, '{_DEADRX}') AND NOT regexp_matches(st, 'proposed|pending|provisional|unreviewed')""",
    "q_markdown_lines": """
WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), a AS (SELECT c_nationkey AS k, count(*)::INT AS a FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*)::INT AS b FROM supplier GROUP BY 1)
SELECT 1::BIGINT AS line_no, '| Brand | Parts |' AS line UNION ALL SELECT 2, '|---|---|' UNION ALL SELECT row_number() OVER (ORDER BY n DESC, p_brand) + 2, '| ' || p_brand || ' | ' || n::VARCHAR || ' |' FROM c
UNION ALL SELECT k + 1000, concat_ws('/', a::VARCHAR, b::VARCHAR, (a - b)::VARCHAR) FROM a FULL JOIN b USING (k)""",
    "q_lint_registry": _lint_sql(),
    "q_rewrite_reasons": """
WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT array_to_string(list_sort(list_filter([CASE WHEN k % 5 = 0 THEN 'novelty_trigger:contents lists available' END, CASE WHEN k % 70 < 10 OR 1970 + k % 70 > 2027 THEN 'implausible_year' END, CASE WHEN k % 3 = 0 THEN 'missing_required_sections' END, CASE WHEN k % 5 = 1 THEN 'novelty_too_long' END, CASE WHEN k % 7 = 0 THEN 'placeholder_language' END], lambda v: v IS NOT NULL)), ',') AS reasons, count(*) AS n FROM o GROUP BY 1""",
}
