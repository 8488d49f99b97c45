"""Operators over the whole registry: statistics, coverage, consensus requirements, ledger repairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coded, detect, metrics
from ..functions.missing import is_missing
from ..functions.text import let, tokens
from . import ledger_rules, pairs
from .merge import next_ids

# Architectures that count as deep learning, first and last year of the window.
DEEP = ("A2", "A3", "A4", "A5", "A7")
WINDOW = (2021, 2026)


def statistics(registry: DataFrame) -> DataFrame:
    """(section, item, n, of, pct): the registry's bundle of counts and shares, each section in one aggregate over the included rows.

    Sections: rows (all, copies, out of scope, included), tier by year, tier of classification tasks, task, domain,
    design, architecture, domain by task, XAI, ADNI, deep learning by year, sample size (median and quartiles).
    """
    copy = ~is_missing(F.col("duplicate_of"), "duplicate")
    scope = F.lower(F.coalesce("Modality", F.lit(""))).rlike("out[-_]of[-_]scope")
    d = coded.derived(coded.included(registry))
    d = d.withColumns({"bucket": coded.year_bucket(F.col("year")), "classification": F.col("task").isin("T1", "T2", "T3"), "adni": F.lower(F.trim(F.coalesce("ADNI_Dependent", F.lit("")))) == "true", "deep": F.col("arch").isin(*DEEP)})

    def share(section: str, item: Column, rows: DataFrame, within: Column | None = None) -> DataFrame:
        counts = rows.groupBy(item.alias("item"), (within if within is not None else F.lit("")).alias("_w")).agg(F.count("*").cast("double").alias("n"))
        of = F.sum("n").over(Window.partitionBy("_w"))
        return counts.select(F.lit(section).alias("section"), F.concat_ws("|", F.nullif("_w", F.lit("")), "item").alias("item"), "n", of.alias("of"), coded.percent(F.col("n"), of).alias("pct"))

    def flag(section: str, when: Column, rows: DataFrame, by: Column) -> DataFrame:
        counts = rows.groupBy(by.alias("item")).agg(F.count_if(when).cast("double").alias("n"), F.count("*").cast("double").alias("of"))
        return counts.select(F.lit(section).alias("section"), "item", "n", "of", coded.percent(F.col("n"), F.col("of")).alias("pct"))

    named = lambda **items: F.explode(F.array(*[F.struct(F.lit(k).alias("item"), v.cast("double").alias("n")) for k, v in items.items()]))
    rows = registry.agg(F.count("*").alias("all"), F.count_if(copy).alias("copies"), F.count_if(copy & F.trim("duplicate_of").rlike(r"^P-\d+")).alias("copies_of_papers"), F.count_if(~copy & scope).alias("out_of_scope"), F.count_if(~copy & ~scope).alias("included"))
    rows = rows.select(named(**{c: F.col(c) for c in rows.columns}).alias("x")).select(F.lit("rows").alias("section"), "x.item", "x.n", F.lit(None).cast("double").alias("of"), F.lit(None).cast("double").alias("pct"))
    q = d.agg(F.count("sample_n").alias("n"), F.percentile("sample_n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    sizes = q.select(named(usable=F.col("n"), q25=F.col("q")[0], median=F.col("q")[1], q75=F.col("q")[2]).alias("x")).select(F.lit("sample_n").alias("section"), "x.item", "x.n", F.lit(None).cast("double").alias("of"), F.lit(None).cast("double").alias("pct"))
    own = d.where("classification")
    parts = [
        rows, sizes, share("tier_by_year", F.col("tier"), d, F.col("bucket")), share("tier", F.col("tier"), d), share("classification_tier", F.col("tier"), own), share("task", F.col("task"), d), share("domain", F.col("domain"), d),
        share("design", F.col("design"), d), share("arch", F.col("arch"), d), share("domain_by_task", F.concat_ws("|", "domain", "task"), d), flag("adni", F.col("adni"), d, F.lit("corpus")), flag("adni", F.col("adni"), own, F.lit("classification")),
        flag("xai", F.col("has_xai"), d, F.lit("corpus")), flag("xai", F.col("has_xai"), own, F.lit("classification")), flag("deep_by_year", F.col("deep"), d.where(F.col("year").between(*WINDOW)), F.col("year").cast("string")),
        flag("v4_by_year", F.col("tier") == "V4", own.where(F.col("year").between(*WINDOW)), F.col("year").cast("string")), flag("in_window", F.coalesce(F.col("year").between(*WINDOW), F.lit(False)), d, F.lit("corpus")),
        flag("default_tier", F.col("tier") == "V2", d.where("task = 'T6' or design = 'randomized_controlled_trial'"), F.when(F.col("task") == "T6", "T6").otherwise("RCT")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def appraisal(registry: DataFrame, cited: DataFrame) -> DataFrame:
    """(instrument, n, external, adni, suspect) of the cited (pid) papers that are included."""
    own = coded.included(registry).join(cited, F.col("Paper_ID") == F.col("pid"), "left_semi")
    best = metrics.discrimination(F.col("Best_Metric"))
    adni = F.lower(F.trim(F.coalesce("ADNI_Dependent", F.lit("")))).isin("yes", "true", "1")
    marked = own.select(detect.instrument(F.col("study_design_type")).alias("instrument"), metrics.external(F.col("Validation_Type")).alias("e"), adni.alias("a"), metrics.suspect_internal(best, F.col("Validation_Type")).alias("s"))
    return marked.groupBy("instrument").agg(F.count("*").alias("n"), F.count_if("e").alias("external"), F.count_if("a").alias("adni"), F.count_if("s").alias("suspect"))


def flagged(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Ids flagged before or now, once each: a run without findings takes none away."""
    return before.select(key).unionByName(now.select(key)).distinct()


def most_common(df: DataFrame, item: str) -> DataFrame:
    """(item, n), most frequent first, ties by item."""
    return df.groupBy(item).agg(F.count("*").alias("n")).orderBy(F.desc("n"), item)


def graph_counts(registry: DataFrame, findings: DataFrame, support: DataFrame, conflicts: DataFrame, complementary: DataFrame, gaps: DataFrame, invalidated: DataFrame) -> DataFrame:
    """(entity, n, detail): nodes of the knowledge graph and what their tables show; one aggregate a ledger."""
    c = F.col
    n = support.distinct().groupBy("id").agg(F.count("*").alias("n_support"))
    vf = findings.join(n, "id", "left").withColumn("shown", ledger_rules.finding_shown(c("id"), c("manuscript_status"), c("status"), F.lit(""), c("n_support")))
    cf = conflicts.withColumn("shown", ledger_rules.conflict_shown(F.coalesce(F.nullif("genuine_conflict", F.lit("")), "genuine"), c("status"), c("resolution_status")))
    co = complementary.withColumn("shown", ledger_rules.complementary_shown(c("status"), c("review_status")))
    gp = gaps.withColumn("state", ledger_rules.gap_state(c("status"), c("current_status"))).withColumn("shown", ledger_rules.gap_shown(c("id"), c("status"), c("current_status")) & ~ledger_rules.candidate_gap(c("id"), c("status"), c("current_status"), c("gap_type")))
    ia = invalidated.withColumn("shown", ledger_rules.invalidated_shown(c("status"), c("review_status")))
    adni = F.lower(F.trim(F.coalesce("ADNI_Dependent", F.lit("")))) == "true"
    codes = registry.select(F.explode(coded.categories(c("Category"), "codes")).alias("code"))
    row = lambda df, name, n, detail: df.agg(n.alias("n"), detail.cast("double").alias("detail")).select(F.lit(name).alias("entity"), F.col("n").cast("bigint").alias("n"), "detail")
    parts = [
        row(registry, "papers", F.count("*"), coded.percent(F.count_if(adni), F.count("*"))), row(codes, "categories", F.countDistinct("code"), F.lit(None)), row(vf, "findings", F.count_if("shown"), F.avg(F.when(c("shown"), c("n_support")))),
        row(cf, "conflicts", F.count("*"), F.count_if("shown")), row(co, "complementary", F.count_if("shown"), F.lit(None)), row(gp, "gaps", F.count_if("shown"), F.count_if(c("shown") & (c("state") == "open"))), row(ia, "invalidated", F.count_if("shown"), F.lit(None)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def combination_exists(wanted: DataFrame, registry: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows of ``wanted`` (ids, task, method, modality) for which a row of the task holds both texts.

    Rows meet on the task and on the modality's and method's distinct texts, of which there are few; substrings are
    sought among those.
    """
    r = registry.select(F.trim("Task_Type").alias("task"), F.lower(F.trim("Method_Architecture")).alias("r_method"), F.lower(F.trim("Modality")).alias("r_modality")).distinct()
    w = wanted.where("method <> '' and modality <> ''").select("task", "method", "modality").distinct()
    hit = w.join(r, "task").where(F.contains("r_method", F.col("method")) & F.contains("r_modality", F.col("modality"))).select("task", "method", "modality").distinct()
    return wanted.join(hit, ["task", "method", "modality"], "left_semi")


def missing_combinations(registry: DataFrame, most: int = 3) -> DataFrame:
    """(Paper_ID, other, task): up to ``most`` later papers (by number) of one task and disjoint nodes whose method and modality no row combines, either way.

    Combinations are judged once for each distinct (task, method, modality); the papers of a combination are taken in
    order of number, so no more than ``most`` a paper and combination are looked at.
    """
    d = registry.select("Paper_ID", coded.paper_number(F.col("Paper_ID")).alias("number"), F.trim("Task_Type").alias("task"), F.lower(F.trim("Method_Architecture")).alias("method"), F.lower(F.trim("Modality")).alias("modality"), metrics.modality_nodes(F.col("Modality")).alias("nodes"))
    d = d.where((F.size("nodes") > 0) & (F.col("task") != ""))
    kinds = d.groupBy("task", "method", "modality").agg(F.first("nodes").alias("nodes"))
    a, b = (kinds.select("task", *[F.col(c).alias(f"{s}_{c}") for c in ("method", "modality", "nodes")]) for s in "ab")
    both = a.join(b, "task").where(~F.arrays_overlap("a_nodes", "b_nodes"))
    one = combination_exists(both.select("*", F.col("a_method").alias("method"), F.col("b_modality").alias("modality")), registry, ()).select(*both.columns)
    two = combination_exists(both.select("*", F.col("b_method").alias("method"), F.col("a_modality").alias("modality")), registry, ()).select(*both.columns)
    keys = ["task", "a_method", "a_modality", "b_method", "b_modality"]
    open_ = both.join(one.unionByName(two).select(*keys).distinct(), keys, "left_anti").select(*keys)
    firsts = d.withColumn("_k", F.row_number().over(Window.partitionBy("task", "method", "modality").orderBy("number"))).where(F.col("_k") <= most)
    mine = d.select("Paper_ID", "number", "task", F.col("method").alias("a_method"), F.col("modality").alias("a_modality")).join(open_, ["task", "a_method", "a_modality"])
    other = firsts.select(F.col("Paper_ID").alias("other"), F.col("number").alias("o_number"), "task", F.col("method").alias("b_method"), F.col("modality").alias("b_modality"))
    rank = F.row_number().over(Window.partitionBy("Paper_ID").orderBy("o_number"))
    return mine.join(other, ["task", "b_method", "b_modality"]).withColumn("_k", rank).where(F.col("_k") <= most).select("Paper_ID", "other", "task")


# Requirements of a consensus claim, by default and for some claims; markers of the families that a claim may require.
REQUIREMENTS = {"required_modality_family": "any", "required_design": "any", "min_task_hits": 5}
OVERRIDES = {"VF-03": ("any", "longitudinal"), "VF-04": ("functional_mri", "any"), "VF-08": ("graph_nn", "any"), "VF-13": ("retinal", "any")}
FAMILY_MARKERS = {
    "functional_mri": ("fmri", "rs-fmri", "resting-state", "resting state", "functional mri", "functional connectivity", "dmn", "vmhc", "alff", "reho"),
    "graph_nn": ("graph neural", "gnn", "gcn", "gat", "hypergraph", "graph-based", "graph based", "graph embedding", "graph attention"),
    "retinal": ("retina", "retinal", "fundus", "oct", "ocular", "eye"),
    "clinical_population": (*dict(metrics.FAMILIES)["clinical_survey"], "cohort", "population", "epidemiolog", "registry", "community-dwelling", "tabular", "risk factor", "case-control"),
    "functional_neuroimaging": (*dict(metrics.FAMILIES)["functional_mri"], "fnirs", "near-infrared", "pet", "fdg", "perfusion", "asl", "spect", "metabolic", "activation"),
}
FUSION = ("multimodal", "multi-modal", "multimodality", "fusion", "combined", "mri/pet", "trimodal", "bimodal")
FAMILY_NAMES = {"fmri": "functional_mri", "rs_fmri": "functional_mri", "rs-fmri": "functional_mri", "graph": "graph_nn", "graph_neural": "graph_nn", "gnn": "graph_nn", "ocular": "retinal", "fundus": "retinal", "oct": "retinal"}
DESIGN_MARKERS = ("longitudinal", "follow-up", "follow up", "trajectory", "timepoint", "time-point", "serial", "prospective")


def with_requirements(findings: DataFrame) -> DataFrame:
    """Findings with their requirements: blanks by default, some claims by rule, task hits of at least one."""
    df = findings
    for column, default in REQUIREMENTS.items():
        if column not in df.columns:
            df = df.withColumn(column, F.lit(None).cast("int" if isinstance(default, int) else "string"))
    family, design = (F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("any")) for c in ("required_modality_family", "required_design"))
    for claim, (f, d) in OVERRIDES.items():
        family, design = F.when(F.col("id") == claim, f).otherwise(family), F.when(F.col("id") == claim, d).otherwise(design)
    hits = F.col("min_task_hits").try_cast("int")
    return df.withColumns({"required_modality_family": family, "required_design": design, "min_task_hits": F.when(hits >= 1, hits).otherwise(REQUIREMENTS["min_task_hits"])})


def _has(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(w.replace(".", r"\.") for w in words))


def matches_modality(required: Column, modality: Column, method: Column) -> Column:
    """Whether a paper is of the family that a claim requires; a family that cannot be judged counts as met (``judgeable`` tells which)."""
    req = F.lower(F.trim(F.coalesce(required, F.lit(""))))
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FAMILY_NAMES.items() for x in kv]), req), req)
    text = F.lower(F.trim(F.concat_ws(" ", F.coalesce(modality, F.lit("")), F.coalesce(method, F.lit("")))))
    nodes = F.transform(metrics.modality_nodes(modality), lambda n: F.lower(n))
    return let(F.struct(named.alias("req"), text.alias("text"), F.lower(metrics.modality_family(modality, method)).alias("family"), nodes.alias("nodes"), judgeable(required).alias("judged")), _meets)


def _meets(p: Column) -> Column:
    families = [F.when(_has(p["text"], words), 1).otherwise(0) for _, words in metrics.FAMILIES]
    multimodal = _has(p["text"], FUSION) | (sum(families[1:], families[0]) >= 2)
    out = F.when(p["req"].isin("", "any"), True).when(p["req"] == "multimodal", multimodal)
    for name, words in FAMILY_MARKERS.items():
        out = out.when(p["req"] == name, _has(p["text"], words))
    return out.otherwise((p["req"] == p["family"]) | F.array_contains(p["nodes"], p["req"]) | ~p["judged"])


def judgeable(required: Column) -> Column:
    req = F.lower(F.trim(F.coalesce(required, F.lit(""))))
    return req.isin("", "any", "multimodal", *FAMILY_MARKERS, *FAMILY_NAMES, *[n for n, _ in metrics.FAMILIES])


def matches_design(required: Column, tier: Column, evidence: Column) -> Column:
    """Whether a paper meets a required design: longitudinal needs an outer validation tier or a marker in its evidence, others are met."""
    longitudinal = F.lower(F.trim(F.coalesce(required, F.lit("")))) == "longitudinal"
    return ~longitudinal | F.upper(F.trim(F.coalesce(tier, F.lit("")))).isin("V3", "V4") | _has(F.lower(evidence), DESIGN_MARKERS)


def review_queue(findings: DataFrame, support: DataFrame, registry: DataFrame) -> DataFrame:
    """Findings with their number of supporters and the queue of those that are unknown or do not meet the requirements. Nothing is taken away."""
    papers = registry.select(F.col("Paper_ID").alias("pid"), "Modality", "Method_Architecture", "Validation_Type", evidence_text(F.lit("")).alias("_evidence"), F.lit(True).alias("_known"))
    each = support.distinct().join(findings.select("id", "required_modality_family", "required_design"), "id").join(papers, "pid", "left")
    kinds = each.select("required_modality_family", "Modality", "Method_Architecture").distinct()  # judged once each
    kinds = kinds.withColumn("_fits", matches_modality(F.col("required_modality_family"), F.col("Modality"), F.col("Method_Architecture")))
    same = ("required_modality_family", "Modality", "Method_Architecture")
    each = each.join(kinds.select("_fits", *[F.col(c).alias(f"k_{c}") for c in same]), [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in same], "left")
    fits = F.coalesce(F.col("_known") & F.col("_fits") & matches_design(F.col("required_design"), F.col("Validation_Type"), F.col("_evidence")), F.lit(False))
    queue = each.groupBy("id").agg(F.count("*").alias("n"), F.count_if(~fits).alias("queued"), F.array_sort(F.collect_list(F.when(~fits, F.col("pid")))).alias("queue"))
    return findings.join(queue, "id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "queued": F.coalesce("queued", F.lit(0)), "queue": F.coalesce("queue", F.array().cast("array<string>"))})


def evidence_text(summary: Column) -> Column:
    """A paper's descriptive fields and its summary as one text; empty fields are left out."""
    fields = ("Paper_ID", "Category", "Modality", "Method_Architecture", "Task_Type", "Best_Metric", "Validation_Type", "Key_Novelty", "Primary_Limitation", "Architecture_Family", "XAI_Method")
    return F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in fields], F.nullif(summary, F.lit("")))


def complementary_text(findings: Column, limits: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("Paper_ID", "Task_Type", "Modality", "Key_Novelty")], F.nullif(findings, F.lit("")), F.nullif(limits, F.lit("")))


# Forms of gap statements that say nothing, and the closure that gives away a single paper's limitation.
POINTER = r"(?i)^Missing cross-combination for T[1-6]:\s*P-\d+\s+method with\s+P-\d+\s+modality\s+\(or inverse\)$"
NO_COMBINATION = r"(?i)^No (?:published study|paper) combines\b"
LIMITATION_CLOSURE = "Requires follow-up validated study addressing this limitation"


def noisy_gap(kind: Column, tier: Column, statement: Column, human: Column) -> Column:
    """A combinatorial gap that nobody kept by hand and whose statement is empty or a bare pointer."""
    text = F.trim(F.coalesce(statement, F.lit("")))
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return ((low(kind) == "combinatorial") | (low(tier) == "combinatorial")) & (F.coalesce(human, F.lit("")) == "") & ((text == "") | text.rlike(POINTER) | text.rlike(NO_COMBINATION))


def single_paper_limitation(closure: Column, claiming: Column, human: Column) -> Column:
    return (F.coalesce(human, F.lit("")) == "") & (F.trim(F.coalesce(closure, F.lit(""))) == LIMITATION_CLOSURE) & (F.size(claiming) == 1)


def clean_gaps(gaps: DataFrame) -> DataFrame:
    """Gaps (id, gap_statement, gap_type, tier, claiming, closure_criteria, human_note, status, current_status) with ``action`` (pruned, rejected, kept) and ``state``."""
    state = F.lower(F.trim(F.coalesce(F.nullif("current_status", F.lit("")), F.nullif("status", F.lit("")), F.lit(""))))
    noisy = noisy_gap(F.col("gap_type"), F.col("tier"), F.col("gap_statement"), F.col("human_note"))
    single = state.isin("candidate", "open") & single_paper_limitation(F.col("closure_criteria"), F.col("claiming"), F.col("human_note"))
    out = gaps.withColumn("action", F.when(noisy, "pruned").when(single, "rejected").otherwise("kept"))
    return out.withColumn("state", F.when(F.col("action") == "rejected", "rejected").otherwise(state))


def consistent(conflicts: DataFrame, registry: DataFrame) -> DataFrame:
    """Conflicts whose two flags contradict each other, or whose gap is below the larger threshold of their papers' tiers, are no conflicts; ``note`` says why."""
    df = conflicts
    for side in "ab":
        df = df.join(registry.select(F.col("Paper_ID").alias(f"paper_{side}"), F.col("Validation_Type").alias(f"_{side}")), f"paper_{side}", "left")
    one, two = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("genuine", "genuine_conflict"))
    against = (one.isin("no", "false") & (two == "true")) | (one.isin("yes", "true") & (two == "false"))
    least = F.greatest(pairs.tier_threshold(F.coalesce("_a", F.lit("V2"))), pairs.tier_threshold(F.coalesce("_b", F.lit("V2"))))
    small = F.coalesce(F.col("gap_magnitude") < least, F.lit(False))
    note = F.concat_ws(" ", F.when(against, "[contradictory flags]"), F.when(small, F.format_string("[gap %.3f below threshold %.3f]", F.col("gap_magnitude"), least)))
    fixed = against | small
    return df.withColumns({"note": note, "_fix": fixed}).withColumns({"genuine": F.when(F.col("_fix"), "No").otherwise(F.col("genuine")), "genuine_conflict": F.when(F.col("_fix"), "false").otherwise(F.col("genuine_conflict"))}).drop("_a", "_b", "_fix")


def backfill_families(conflicts: DataFrame, registry: DataFrame, last: int) -> DataFrame:
    """Modality families of the first ``last`` conflicts from their papers, where they are not known."""
    df = conflicts
    for side in "ab":
        family = metrics.modality_family(F.col("Modality"), F.col("Method_Architecture"))
        df = df.join(registry.select(F.col("Paper_ID").alias(f"paper_{side}"), family.alias(f"_{side}")), f"paper_{side}", "left")
    own = F.coalesce(F.regexp_extract(F.upper(F.trim("id")), r"^C-(\d+)$", 1).try_cast("int").between(1, last) & F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.lit(False))
    unknown = F.lower(F.trim(F.coalesce("modality_family", F.lit("")))).isin("", "unknown", "not_reported", "not reported")
    found = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.concat_ws("|", "_a", "_b"))
    equal = F.when(F.col("_a") == F.col("_b"), "Yes").otherwise("No")
    return df.withColumns({"modality_family": F.when(own & unknown, found).otherwise(F.col("modality_family")), "family_equal": F.when(own & (F.coalesce("family_equal", F.lit("")) == ""), equal).otherwise(F.col("family_equal"))}).drop("_a", "_b")


def append_candidates(gaps: DataFrame, candidates: DataFrame, conflicts: DataFrame, near: float = 0.35) -> DataFrame:
    """Candidates (order, gap_type, modality, task_type, paper_a, paper_b, gap_statement, closure_criteria, tier) with ``outcome``, the ``match`` they merge into, and an ``id`` where they are new.

    Out of scope, else merged into a known gap (structural ones by modality and task, combinatorial ones by their pair,
    others by the most similar statement of their tier), else a pair that is a conflict already, else new. Candidates
    of one structural cell or one pair are merged into the first of them. Statements meet on shared words.
    """
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).try_cast("int")
    c = candidates.withColumns({"_scope": F.size(detect.out_of_scope(F.col("gap_statement"), F.col("closure_criteria"))), "_pair": F.array_join(F.array_sort(F.array("paper_a", "paper_b")), "|")})
    cell, pair = F.col("gap_type").isin("structural_absence", "underrepresentation"), F.col("gap_type") == "combinatorial"
    key = F.when(cell, F.concat_ws("|", "gap_type", "modality", "task_type")).when(pair, F.concat_ws("|", F.lit("pair"), "_pair"))
    g = gaps.withColumn("_pair", F.array_join(F.array_sort(F.array("paper_a", "paper_b")), "|")).withColumn("_key", key)
    exact = g.where("_key is not null").groupBy("_key").agg(F.min_by("id", number("id")).alias("_exact"))
    c = c.withColumn("_key", key).join(exact, "_key", "left")
    words = lambda d: d.withColumn("_w", tokens(F.col("gap_statement")))
    a = words(c.where("_key is null and _scope = 0")).select("order", "tier", F.col("_w").alias("a"), F.explode("_w").alias("w"))
    b = words(g).select("id", "tier", F.col("_w").alias("b"), F.explode("_w").alias("w"))
    met = a.join(b, ["tier", "w"]).groupBy("order", "id").agg(F.count("*").alias("n"), F.first(F.size("a")).alias("na"), F.first(F.size("b")).alias("nb"))
    similar = met.withColumn("s", F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).where(F.col("s") >= near).groupBy("order").agg(F.max_by("id", F.struct("s", -number("id"))).alias("_near"))
    known = conflicts.select(F.array_join(F.array_sort(F.array("paper_a", "paper_b")), "|").alias("_pair"), F.lit(True).alias("_conflict")).distinct()
    c = c.join(similar, "order", "left").join(known, "_pair", "left")
    first = F.min(F.when((F.col("_scope") == 0) & F.col("_exact").isNull() & F.col("_key").isNotNull() & F.col("_conflict").isNull(), F.col("order"))).over(Window.partitionBy("_key"))
    c = c.withColumn("_first", F.when(F.col("_key").isNotNull(), first))
    c = c.withColumn("match", F.when(F.col("_scope") == 0, F.coalesce("_exact", "_near")))
    outcome = F.when(F.col("_scope") > 0, "out of scope").when(F.col("match").isNotNull(), "merged").when(F.coalesce("_conflict", F.lit(False)), "conflict").when(F.col("_first") < F.col("order"), "merged into new").otherwise("new")
    c = c.withColumn("outcome", outcome)
    new = next_ids(gaps, c.where("outcome = 'new'").select("order"), "id", "G-CAND-", ["order"])
    return c.drop("_scope", "_pair", "_key", "_exact", "_near", "_conflict", "_first").join(new, "order", "left")
