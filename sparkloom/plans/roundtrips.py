"""Sources and sinks: what is written through a sink and read back by a source is what the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import merge
from ..session import shared_path
from ..sources import readers, writers
from .reports import _t
from .world import WORLD, ctes, world


def q_registry_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry appended to a CSV twice, line breaks and quotes in its cells; of rows with one id the last."""
    path = f"{shared_path(spark, 'registry')}/csv"
    rows = world(spark, sf_dir, "registry").select(*[F.col(c) if c in _HELD else F.lit("").alias(c) for c in readers.REGISTRY])
    first = rows.withColumns({"Key_Novelty": F.concat(F.lit('first "quoted"\r\nline of '), "Key_Novelty"), "Journal": F.lit("1")})
    writers.append_csv(first, path)
    writers.append_csv(rows.where("Validation_Type = 'V2'").withColumn("Journal", F.lit("2")), path)
    back = readers.registry(spark, path, learned=["learned_field"])
    return readers.last_by_id(back, "Paper_ID", "Journal").select("Paper_ID", "Modality", "Key_Novelty", "Journal", "Sample_N_Approx", F.col("learned_field").isNull().alias("unlearned"))


_HELD = {c for c in readers.REGISTRY if f" AS {c}" in WORLD["registry"]}


def q_ledger_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ledgers as JSON, a list and an object that holds one; their fields and the papers they refer to."""
    n = _t(spark, sf_dir, "nation")
    record = F.struct(F.concat(F.lit("VF-"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("statement"), F.array(F.concat(F.lit("P-"), F.col("n_nationkey").cast("string")), F.concat(F.lit("P-"), F.col("n_regionkey").cast("string"))).alias("supporting_papers"), F.when(F.col("n_nationkey") % 2 == 0, "P-9").alias("paper_a"), F.col("n_regionkey").alias("tier"))
    whole = n.select(record.alias("r")).agg(F.array_sort(F.collect_list("r"), lambda a, b: F.when(a["statement"] < b["statement"], -1).otherwise(1)).alias("records"))
    parts = []
    for name, value in (("list", F.to_json("records")), ("object", F.to_json(F.struct(F.col("records").alias("verified_findings"), F.lit(1).alias("version"))))):
        path = f"{shared_path(spark, 'ledger')}/{name}"
        whole.select(value.alias("value")).write.text(path)
        records = readers.ledger(spark, path, "verified_findings")
        refs = readers.references(records, "id", ["supporting_papers"], ["paper_a"], name)
        fields = records.select(F.lit(name).alias("ledger"), readers.field("record", "id"), readers.field("record", "tier", "int"), "pos")
        parts.append(refs.join(fields, [F.col("record") == fields["id"], refs["ledger"] == fields["ledger"]]).select(refs["ledger"], "record", "field", "pid", "tier"))
    return parts[0].unionByName(parts[1])


def q_record_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records with one field edited, the others as they were; and a keyed replacement of rows."""
    s = _t(spark, sf_dir, "supplier")
    records = s.select("s_suppkey", F.to_json(F.struct("s_name", F.col("s_nationkey").cast("string").alias("nation"), F.lit("x").alias("kept"))).alias("record"))
    edits = s.where("s_acctbal > 0").select("s_suppkey", F.lit("nation").alias("field"), F.lit("99").alias("value"))
    out = merge.edit_field(records, "s_suppkey", edits).withColumn("r", F.from_json("record", "s_name string, nation string, kept string")).select("s_suppkey", "r.s_name", "r.nation", "r.kept")
    news = out.where("nation = '99'").withColumn("kept", F.lit("y"))
    return merge.upsert(out, news, "s_suppkey")


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(number, title, body) of one Markdown block a part."""
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("number"), F.initcap("p_name").alias("title"), "p_type", "p_brand", "p_size")
    body = F.concat(
        F.lit("## Paper "), F.col("number").cast("string"), F.lit(": "), "title", F.lit("\n\n### Task Type\nT"), (F.col("number") % 6 + 1).cast("string"), F.lit(" of "), "p_type", F.lit("\n\n### What did the authors do?\nThey read "), "p_brand", F.lit(".\nTwice.\n\n"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("### Key findings reported\nsize "), F.col("p_size").cast("string"), F.lit("\n"))).otherwise(F.lit("### Potential gaps or limitations\nsmall\n")),
    )
    return p.select("number", "title", body.alias("body"))


def q_markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written as one document and read back: their sections by exact title, by words, and all of them."""
    path = f"{shared_path(spark, 'blocks')}/md"
    writers.blocks(_markdown(spark, sf_dir), path)
    blocks = readers.blocks(spark, path)
    parts = readers.sections(blocks)
    exact = readers.exact_section(parts, ["Key findings reported", "Potential gaps or limitations"]).select("pid", F.col("text").alias("exact"))
    best = readers.best_section(parts, ["authors", "do"]).select("pid", F.col("header").alias("best_header"), F.regexp_replace("text", "\n", "/").alias("best"))
    count = parts.groupBy("pid").agg(F.count("*").alias("n"), F.max("pos").alias("last"))
    return blocks.select("pid", "title").join(exact, "pid").join(best, "pid").join(count, "pid")


def q_stub_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of duplicate papers get a stub's title and notice, replaced blocks their new text; leaves of duplicates go."""
    blocks = _markdown(spark, sf_dir).select(F.concat(F.lit("P-"), F.col("number").cast("string")).alias("pid"), "title", "body", "number")
    first = blocks.groupBy("title").agg(F.min("number").alias("first"))
    pairs = blocks.join(first, "title").where("number > first").select(F.col("pid").alias("dup"), F.concat(F.lit("P-"), F.col("first").cast("string")).alias("original"))
    stubbed = writers.stub_headers(blocks.select("pid", "title", "body"), pairs)
    new = stubbed.where("title not like '[STUB%'").withColumn("body", F.lit("new"))
    out = writers.upsert_blocks(stubbed, new)
    leaves = writers.without_leaves(blocks.select("pid"), pairs).withColumn("leaf", F.lit(True))
    return out.join(leaves, "pid", "left").select("pid", "title", F.length("body").alias("size"), F.coalesce("leaf", F.lit(False)).alias("leaf"))


def q_csv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide CSV of every order, read back by two of its columns."""
    path = f"{shared_path(spark, 'wide')}/csv"
    _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.lit("unused, with a comma").alias("note")).write.option("header", True).csv(path)
    wide = readers.wide_csv(spark, path, ["o_orderpriority", "day"])
    small = f"{shared_path(spark, 'results')}/csv"
    writers.results(wide.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min("day").alias("first")), small)
    return readers.wide_csv(spark, small, ["o_orderpriority", "n", "first"]).withColumn("n", F.col("n").cast("bigint"))


def q_json_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON file a record, the adjudicated ones over the primary ones."""
    n = _t(spark, sf_dir, "nation").select(F.concat(F.lit("P-"), F.col("n_nationkey").cast("string")).alias("pid"), F.col("n_name").alias("overall"), F.col("n_regionkey").cast("string").alias("category"))
    paths = [f"{shared_path(spark, 'json')}/{k}" for k in ("primary", "adjudicated")]
    n.write.option("maxRecordsPerFile", 1).json(paths[0])
    n.where("category in ('1', '3')").select("pid", F.lit("judged").alias("overall")).write.option("maxRecordsPerFile", 1).json(paths[1])
    primary, better = (readers.json_records(spark, p, "pid string, overall string, category string") for p in paths)
    return readers.overridden(primary.drop("source_id"), better.select("pid", "overall"), "pid")


def q_chunked_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in order of name, thirty to a chunk."""
    path = f"{shared_path(spark, 'chunks')}/json"
    writers.chunked(_t(spark, sf_dir, "customer").select("c_name", "c_custkey"), path, "c_name")
    return spark.read.schema("c_name string, c_custkey bigint, chunk int").json(path).groupBy("chunk").agg(F.count("*").alias("n"), F.min("c_name").alias("first"), F.max("c_name").alias("last"))


def q_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, overwritten as a whole and read back."""
    path = f"{shared_path(spark, 'events')}/log"
    e = _t(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    writers.overwrite_json(e.where("event_type = 'error'"), path)
    writers.overwrite_json(e, path)
    return readers.event_log(spark, path, "event_id bigint, event_type string, user_id bigint").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.max("event_id").alias("last"))


def q_pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a file at their number and three that no order shows as done; extracts that were short or broken are read anew."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("number"), "c_name")
    files = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_idx"), F.col("p_name").alias("file"))
    done = _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("number"))
    todo = readers.pending(c, files, done, "number", 3)
    d = _t(spark, sf_dir, "documents")
    old = d.select("doc_id", F.when(F.col("source").isNotNull(), F.concat("text", F.when(F.col("lang") == "en", F.repeat(F.lit("□"), 400)).otherwise(F.lit("")))).alias("text"))
    fresh = readers.refreshed(old, d.select("doc_id", F.concat(F.lit("fresh "), "text").alias("text")), "doc_id", "text")
    a = todo.select(F.lit("pending").alias("part"), F.col("number").alias("id"), F.col("file").alias("value"))
    return a.unionByName(fresh.select(F.lit("fresh").alias("part"), F.col("doc_id").alias("id"), F.md5("text").alias("value")))


def q_identity_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of every part as a paper, from its block, its registry row and the map of files."""
    k = F.col("p_partkey")
    p = _t(spark, sf_dir, "part").withColumn("pid", F.concat(F.lit("P-"), k.cast("string")))
    blocks = p.select("pid", F.concat(F.lit("A study of the "), "p_name", F.lit(" and "), "p_type").alias("title"), F.concat(F.lit("see 10.1234/abc."), k.cast("string"), F.lit(" and (10.1234/ABC."), (k % 7).cast("string"), F.lit(") there")).alias("body"))
    registry = p.select(F.col("pid").alias("Paper_ID"), F.when(k % 2 == 0, F.concat(F.lit("doi: 10.5678/X"), k.cast("string"))).alias("doi"))
    mapped = p.select("pid", F.concat(F.lit("in/PMID_"), k.cast("string"), F.lit("_a.pdf")).alias("path"), F.when(k % 5 == 0, "https://doi.org/10.9/nine-nine").alias("map_doi"))
    return readers.identity_signals(blocks, registry, mapped)


def q_link_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page with their target and text."""
    return readers.html_leaves(_t(spark, sf_dir, "pages"), "html", "a", "href", ["page_id"]).groupBy("page_id").agg(F.count("*").alias("n"), F.min("value").alias("first"), F.max("text").alias("last"))


def q_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stop list from a config file or built in, comments and blanks aside; tokens of part names without it."""
    base = shared_path(spark, "vocabulary")
    r = _t(spark, sf_dir, "region")
    r.agg(F.to_json(F.struct(F.collect_list(F.lower("r_name")).alias("words"))).alias("value")).write.text(f"{base}/json")
    r.select(F.explode(F.array(F.concat(F.lit("  "), "r_name", F.lit(" ")), F.lit("# a comment"), F.lit(" "))).alias("value")).write.text(f"{base}/lines")
    named = readers.vocabulary(spark, f"{base}/json", "words", ()).select(F.lit("file").alias("part"), "word")
    built = readers.vocabulary(spark, None, "words", text.STOP_WORDS).select(F.lit("built in").alias("part"), "word")
    return named.unionByName(built).unionByName(readers.lines(spark, f"{base}/lines").select(F.lit("lines").alias("part"), F.col("value").alias("word")))


def q_marked_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document with a table between its markers and an appendix, both replaced."""
    n = _t(spark, sf_dir, "nation")
    doc = F.concat(F.lit("# Report\n<!-- START -->\nold of "), "n_name", F.lit("\n<!-- END -->\ntail\n## Appendix A. Rows\nold rows\n"), F.when(F.col("n_regionkey") > 1, "## Appendix B. More\nkept\n").otherwise(""))
    table = F.concat(F.lit("| $1 | "), "n_name", F.lit(" |"))
    out = writers.replace_between(doc, "<!-- START -->", "<!-- END -->", table)
    out = writers.upsert_section(out, r"Appendix\s+A", r"Appendix\s+[B-Z]", F.concat(F.lit("## Appendix A. Rows\nnew \\1 rows of "), "n_name"))
    return n.select("n_nationkey", out.alias("document"), writers.upsert_section(F.lit("no headings"), r"Appendix\s+A", r"Appendix\s+[B-Z]", F.lit("added")).alias("added"), writers.replace_between(F.lit("no marks"), "<!-- START -->", "<!-- END -->", table).alias("unmarked"))


QUERIES = {
    f.__name__: f
    for f in (
        q_registry_csv, q_ledger_json, q_record_edits, q_markdown_blocks, q_stub_blocks, q_csv_projection, q_json_folder, q_chunked_extracts, q_event_log, q_pending_work, q_identity_signals, q_link_leaves, q_vocabulary, q_marked_report,
    )
}

_TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_HEADLEN = "length('## Paper ' || p_partkey::VARCHAR || ': ' || t || chr(10) || chr(10) || '### Task Type' || chr(10) || 'T' || (p_partkey % 6 + 1)::VARCHAR || ' of ' || p_type || chr(10) || chr(10) || '### What did the authors do?' || chr(10) || 'They read ' || p_brand || '.' || chr(10) || 'Twice.' || chr(10) || chr(10) || CASE WHEN p_size % 2 = 0 THEN '### Key findings reported' || chr(10) || 'size ' || p_size::VARCHAR || chr(10) ELSE '### Potential gaps or limitations' || chr(10) || 'small' || chr(10) END)"
SQL = {
    "q_registry_csv": ctes("registry") + """ SELECT Paper_ID, Modality, CASE WHEN Validation_Type = 'V2' THEN Key_Novelty ELSE 'first "quoted" line of ' || Key_Novelty END AS Key_Novelty, CASE WHEN Validation_Type = 'V2' THEN '2' ELSE '1' END AS Journal, nullif(Sample_N_Approx, '') AS Sample_N_Approx, true AS unlearned FROM registry""",
    "q_ledger_json": """
WITH r AS (SELECT 'VF-' || n_nationkey::VARCHAR AS record, n_nationkey AS n, n_regionkey AS tier FROM nation), f AS (SELECT record, 'supporting_papers' AS field, 'P-' || n::VARCHAR AS pid, tier FROM r UNION ALL SELECT record, 'supporting_papers', 'P-' || tier::VARCHAR, tier FROM r UNION ALL SELECT record, 'paper_a', 'P-9', tier FROM r WHERE n % 2 = 0)
SELECT l AS ledger, record, field, pid, tier FROM f, (VALUES ('list'), ('object')) t(l)""",
    "q_record_edits": "SELECT s_suppkey, s_name, CASE WHEN s_acctbal > 0 THEN '99' ELSE s_nationkey::VARCHAR END AS nation, CASE WHEN s_acctbal > 0 THEN 'y' ELSE 'x' END AS kept FROM supplier",
    "q_markdown_blocks": f"""
SELECT 'P-' || p_partkey::VARCHAR AS pid, {_TITLE} AS title, CASE WHEN p_size % 2 = 0 THEN 'size ' || p_size::VARCHAR ELSE 'small' END AS exact, 'What did the authors do?' AS best_header, 'They read ' || p_brand || './Twice.' AS best, 3::BIGINT AS n, 3 AS last FROM part""",
    "q_stub_blocks": f"""
WITH p AS (SELECT *, {_TITLE} AS t FROM part), m AS (SELECT *, min(p_partkey) OVER (PARTITION BY t) AS first FROM p)
SELECT 'P-' || p_partkey::VARCHAR AS pid, CASE WHEN p_partkey > first THEN '[STUB-DEDUP-OF-P-' || first::VARCHAR || '] ' || t ELSE t END AS title,
  (CASE WHEN p_partkey > first THEN {_HEADLEN} + length('> [STUB-DEDUP P-' || p_partkey::VARCHAR || ' = P-' || first::VARCHAR || ']') + 2 ELSE 3 END)::INT AS size, p_partkey = first AS leaf FROM m""",
    "q_csv_projection": "SELECT o_orderpriority, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first FROM orders GROUP BY 1",
    "q_json_folder": "SELECT 'P-' || n_nationkey::VARCHAR AS pid, CASE WHEN n_regionkey IN (1, 3) THEN 'judged' ELSE n_name END AS overall, n_regionkey::VARCHAR AS category FROM nation",
    "q_chunked_extracts": "SELECT chunk::INT AS chunk, count(*) AS n, min(c_name) AS first, max(c_name) AS last FROM (SELECT c_name, (row_number() OVER (ORDER BY c_name) - 1) // 30 AS chunk FROM customer) GROUP BY 1",
    "q_event_log": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, max(event_id) AS last FROM events GROUP BY 1",
    "q_pending_work": """
WITH o AS (SELECT doc_id, text AS t, CASE WHEN source IS NOT NULL THEN text || CASE WHEN lang = 'en' THEN repeat('□', 400) ELSE '' END END AS x FROM documents)
SELECT 'pending' AS part, c_custkey AS id, p_name AS value FROM customer JOIN part ON p_partkey = c_custkey + 3 WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
UNION ALL SELECT 'fresh', doc_id, md5(CASE WHEN x IS NULL OR length(x) < 200 OR (length(x) - length(translate(x, '�■□', '')))::DOUBLE / length(x) > 0.04 THEN coalesce('fresh ' || t, x) ELSE x END) FROM o""",
    "q_identity_signals": """
WITH p AS (SELECT p_partkey AS k, 'P-' || p_partkey::VARCHAR AS pid, lower('a study of the ' || p_name || ' and ' || p_type) AS t FROM part)
SELECT pid, 'doi_field' AS kind, '10.5678/x' || k::VARCHAR AS value FROM p WHERE k % 2 = 0 UNION ALL SELECT pid, 'map_doi', '10.9/nine-nine' FROM p WHERE k % 5 = 0 UNION ALL SELECT pid, 'identifier', 'PMID:' || k::VARCHAR FROM p UNION ALL SELECT pid, 'filename', 'PMID_' || k::VARCHAR || '_a.pdf' FROM p
UNION ALL SELECT pid, 'title', t FROM p WHERE length(t) >= 25 UNION ALL SELECT DISTINCT pid, 'doi_prose', v FROM (SELECT pid, unnest(['10.1234/abc.' || k::VARCHAR, '10.1234/abc.' || (k % 7)::VARCHAR]) AS v FROM p)""",
    "q_link_leaves": r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*\bhref="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS value, unnest(regexp_extract_all(html, '<a[^>]*\bhref="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS text FROM pages)
SELECT page_id, count(*) AS n, min(value) AS first, max(text) AS last FROM l GROUP BY 1""",
    "q_vocabulary": f"SELECT 'file' AS part, lower(r_name) AS word FROM region UNION ALL SELECT 'lines', r_name FROM region UNION ALL SELECT 'built in', unnest([{', '.join(f'{chr(39)}{w}{chr(39)}' for w in text.STOP_WORDS)}])",
    "q_marked_report": """
SELECT n_nationkey, '# Report' || chr(10) || '<!-- START -->' || chr(10) || '| $1 | ' || n_name || ' |' || chr(10) || '<!-- END -->' || chr(10) || 'tail' || chr(10) || '## Appendix A. Rows' || chr(10) || 'new \\1 rows of ' || n_name || chr(10) || chr(10) || CASE WHEN n_regionkey > 1 THEN '## Appendix B. More' || chr(10) || 'kept' || chr(10) ELSE '' END AS document,
  'no headings' || chr(10) || chr(10) || '# Appendix' || chr(10) || chr(10) || 'added' || chr(10) AS added, 'no marks' AS unmarked FROM nation""",
}
