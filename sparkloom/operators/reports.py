"""Terminal tables of the ledgers and the registry, as DataFrames and as Markdown lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coded
from ..functions.text import compact
from . import ledger_rules

TASKS = ("T1", "T2", "T3", "T4", "T5", "T6")
ARCHITECTURES = ("A1", "A2", "A3", "A4", "A5", "A6", "A7", "A8")
#: Passing complementary findings below which the editor's own rows are shown, and the most that are shown.
FEW, MOST = 5, 10


def clean_cell(col: Column, default: str = "NR") -> Column:
    """One line without bars, or the default where there is nothing."""
    text = F.replace(compact(col), F.lit("|"), F.lit("/"))
    return F.when(text == "", default).otherwise(text)


def short(col: Column, most: int) -> Column:
    """At most ``most`` signs, with an ellipsis where more was cut."""
    text = F.replace(compact(col), F.lit("|"), F.lit("/"))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("...")))


def category_task_matrix(registry: DataFrame, policy: str = "slash") -> DataFrame:
    """(category, t1..t6, total): a paper counts under each of its codes; papers without a code have a row of their own, and the last row counts papers once."""
    d = registry.select(coded.task(F.col("Task_Type")).alias("task"), F.filter(coded.categories(F.col("Category"), policy), lambda c: c.isin(*coded.CATEGORIES)).alias("codes"))
    row = F.when(F.size("codes") == 0, F.array(F.lit("uncoded"))).otherwise(F.array_distinct("codes"))
    counts = [*[F.count_if(F.col("task") == t).alias(t.lower()) for t in TASKS], F.count("*").alias("total")]
    return d.select("task", F.explode(row).alias("category")).groupBy("category").agg(*counts).unionByName(d.agg(*counts).withColumn("category", F.lit("all")).select("category", *[t.lower() for t in TASKS], "total"))


def profile(registry: DataFrame) -> DataFrame:
    """(axis, value, n, pct): validation tiers, dependency on one data set, and architectures with reported XAI."""
    d = registry.select(coded.tier(F.upper("Validation_Type")).alias("tier"), F.when(F.lower(F.trim(F.coalesce("ADNI_Dependent", F.lit("")))) == "true", "dependent").otherwise("independent").alias("adni"), F.when(F.trim("Architecture_Family").isin(*ARCHITECTURES), F.trim("Architecture_Family")).otherwise("Other").alias("arch"), coded.is_missing(F.col("XAI_Method"), "xai").alias("no_xai"))
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), c.alias("value")) for a, c in (("tier", F.col("tier")), ("dataset", F.col("adni")), ("architecture", F.col("arch")), ("architecture with XAI", F.when(~F.col("no_xai"), F.col("arch"))))])
    n = d.select(F.explode(axes).alias("a")).where("a.value is not null").groupBy("a.axis", "a.value").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(registry.agg(F.count("*").alias("of")))).select("axis", "value", "n", coded.percent(F.col("n"), F.col("of")).alias("pct"))


def appendix(registry: DataFrame) -> DataFrame:
    """One row a paper: id, category, task, metric (32 signs), tier and the first twelve words of its novelty."""
    cell = lambda c: clean_cell(F.col(c))
    return registry.select("Paper_ID", cell("Category").alias("category"), cell("Task_Type").alias("task"), F.substring(cell("Best_Metric"), 1, 32).alias("metric"), cell("Validation_Type").alias("tier"), F.array_join(F.slice(F.split(cell("Key_Novelty"), " "), 1, 12), " ").alias("novelty"))


def _number(c: str) -> Column:
    return F.regexp_extract(c, r"(\d+)$", 1).try_cast("int")


def findings_table(findings: DataFrame, support: DataFrame, most: int = 10, shown: int = 8) -> DataFrame:
    """(id, statement, papers): shown findings; of more than ten supporters the first eight by number and how many more."""
    order = F.row_number().over(Window.partitionBy("id").orderBy(_number("pid")))
    each = support.distinct().withColumn("_k", order).withColumn("_n", F.count("*").over(Window.partitionBy("id")))
    first = each.where((F.col("_n") <= most) | (F.col("_k") <= shown)).groupBy("id").agg(F.max("_n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "pid"))), lambda x: x["pid"]), ", ").alias("papers"))
    df = findings.join(first, "id", "left").where(ledger_rules.finding_shown(F.col("id"), F.col("manuscript_status"), F.col("status"), F.lit(""), F.col("n")))
    return df.select("id", short(F.col("statement"), 120).alias("statement"), F.when(F.col("n") > most, F.concat("papers", F.lit(" ... and N="), (F.col("n") - shown).cast("string"), F.lit(" additional"))).otherwise(F.col("papers")).alias("papers"))


def conflicts_table(conflicts: DataFrame) -> DataFrame:
    """(id, claims, genuine) of the conflicts that are shown; a claim that repeats its paper's id loses it."""
    own = lambda p, c: F.concat(F.lit("**"), F.col(p), F.lit(":** "), short(F.regexp_replace(F.coalesce(c, F.lit("")), r"^P-\d+:\s*", ""), 80))
    shown = ledger_rules.conflict_shown(F.coalesce(F.nullif("genuine_conflict", F.lit("")), "genuine"), F.col("status"), F.col("resolution_status"))
    return conflicts.where(shown).select("id", F.concat(own("paper_a", "claim_a"), F.lit(" <br> "), own("paper_b", "claim_b")).alias("claims"), coded.yes_no(F.coalesce("genuine", "genuine_conflict")).alias("genuine"))


def complementary_table(findings: DataFrame, editorial: DataFrame, few: int = FEW, most: int = MOST) -> DataFrame:
    """(id, paper_a, paper_b, insight, editorial): the first ``most`` (by number) confirmed findings whose insight passes, or the editor's own rows where fewer than ``few`` do."""
    own = findings.where(ledger_rules.complementary_shown(F.col("status"), F.col("review_status")) & ledger_rules.insight_ok(F.col("combined_insight")))
    top = own.orderBy(_number("id"), "id").limit(most)  # the table's own length
    cells = lambda df, e: df.select("id", "paper_a", "paper_b", short(F.col("combined_insight"), 200).alias("insight"), F.lit(e).alias("editorial"))
    n = top.agg(F.count("*").alias("_n"))
    return cells(top, False).join(F.broadcast(n)).where(F.col("_n") >= few).drop("_n").unionByName(cells(editorial, True).join(F.broadcast(n)).where(F.col("_n") < few).drop("_n"))


def gaps_table(gaps: DataFrame) -> DataFrame:
    c = F.col
    state = ledger_rules.gap_state(c("status"), c("current_status"))
    own = gaps.where(ledger_rules.gap_shown(c("id"), c("status"), c("current_status")) & ~ledger_rules.candidate_gap(c("id"), c("status"), c("current_status"), c("gap_type")))
    return own.select("id", short(c("gap_statement"), 120).alias("statement"), F.array_join("claiming", ", ").alias("claiming"), state.alias("state"))


def invalidated_table(invalidated: DataFrame, assumptions: DataFrame) -> DataFrame:
    own = invalidated.where(ledger_rules.invalidated_shown(F.col("status"), F.col("review_status")))
    return own.join(assumptions.select("assumption_id", "belief"), "assumption_id", "left").select("id", short(F.col("belief"), 95).alias("belief"), F.coalesce("paper_id", F.lit("")).alias("paper"))


def hub_narrative(paper: DataFrame) -> DataFrame:
    """(Paper_ID, section): the questions about one paper with its coded fields; what is missing reads 'not reported'."""
    cell = lambda c: clean_cell(F.col(c), "not reported")
    head = F.concat(F.lit("**Paper selected:** "), "Paper_ID", F.lit(". Task: "), cell("Task_Type"), F.lit("; best metric: "), cell("Best_Metric"), F.lit("; validation: "), cell("Validation_Type"), F.lit("."))
    parts = [("What is the key contribution?", "Key_Novelty"), ("What are the limitations?", "Primary_Limitation"), ("Which method and data?", "Method_Architecture")]
    return paper.select("Paper_ID", F.concat_ws("\n\n", head, *[F.concat(F.lit(f"**{q}**\n\n"), cell(c)) for q, c in parts]).alias("section"))


def markdown(df: DataFrame, columns: Sequence[str], headers: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(line): a Markdown table of the rows in order, its head before them. Rows stay rows; a sink writes them in order of ``line_no``."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    from .merge import numbered

    body = numbered(df, order, "line_no").select((F.col("line_no") + 2).alias("line_no"), cells.alias("line"))
    head = df.sparkSession.createDataFrame([(1, "| " + " | ".join(headers) + " |"), (2, "|" + "---|" * len(headers))], "line_no bigint, line string")
    return head.unionByName(body)


def difference_report(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b, difference) of a measure in two result tables, one row a key that either has."""
    a, b = (d.select(key, F.col(value).cast("double").alias(n)) for d, n in ((left, "a"), (right, "b")))
    return a.join(b, key, "full").select(key, "a", "b", (F.col("a") - F.col("b")).alias("difference"))
