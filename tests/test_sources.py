import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graph, pairs
from sparkloom.session import ready
from sparkloom.sources import paged, readers, writers
from sparkloom.streaming import incremental


def test_registry_csv(spark, tmp_path):
    f = tmp_path / "r.csv"
    f.write_bytes("﻿Paper_ID,Category,Best_Metric\r\nP-1,\"C3, C5\",\"AUC 0.9\r\nsecond \"\"line\"\"\"\r\nP-2,,\r\n".encode())
    rows = readers.registry(spark, str(f), ["learned"]).collect()
    assert [r.Paper_ID for r in rows] == ["P-1", "P-2"]
    assert rows[0].Best_Metric.replace("\r", "") == 'AUC 0.9\nsecond "line"' and rows[0].learned is None and rows[0].Category == "C3, C5"


@pytest.mark.parametrize("wrap", [lambda x: x, lambda x: {"gaps": x, "summary": {}}])
def test_ledger(spark, tmp_path, wrap):
    f = tmp_path / "l.json"
    f.write_text(json.dumps(wrap([{"id": "G-1", "papers": ["P-1", "P-2"], "sole": "P-9"}, {"id": "G-2"}])))
    records = readers.ledger(spark, str(f), "gaps")
    assert [r.id for r in records.orderBy("pos").select(readers.field("record", "id")).collect()] == ["G-1", "G-2"]
    refs = readers.references(records, "id", ["papers"], ["sole"], "gaps")
    assert sorted((r.field, r.pid) for r in refs.collect()) == [("papers", "P-1"), ("papers", "P-2"), ("sole", "P-9")]


def test_blocks_and_sections(spark, tmp_path):
    f = tmp_path / "s.md"
    f.write_text("intro\n## Paper 12: A title\n### Key Novelty\nnew\nthing\n### Primary limitation\nsmall\n## Paper 3: B\nno sections\n")
    b = readers.blocks(spark, str(f))
    assert sorted((r.pid, r.title) for r in b.collect()) == [("P-12", "A title"), ("P-3", "B")]
    s = readers.sections(b)
    assert [(r.header, r.text) for r in s.orderBy("pos").collect()] == [("Key Novelty", "new\nthing"), ("Primary limitation", "small")]
    assert readers.best_section(s, ["limitation", "primary"]).first().text == "small"
    assert readers.exact_section(s, ["nothing", "key novelty"]).first().text == "new\nthing"


def test_zip_needs_one_member(spark, tmp_path):
    ready(spark)
    for name, members in (("a", ["x.csv"]), ("b", ["x.csv", "y.csv"])):
        (tmp_path / name).mkdir()
        with zipfile.ZipFile(tmp_path / name / "t.zip", "w") as z:
            for m in members:
                z.writestr(m, "RID,OTHER,STATE\n1,z,2\n")
    assert [(r.RID, r.STATE) for r in readers.zip_csv(spark, str(tmp_path / "a"), ["RID", "STATE"]).collect()] == [("1", "2")]
    with pytest.raises(Exception, match="not one"):
        readers.zip_csv(spark, str(tmp_path / "b"), ["RID"]).collect()


def test_records_override(spark, tmp_path):
    for folder, rows in (("p", {"P-1": {"overall": "low", "tool": "a"}, "P-2": {"overall": "high", "tool": "b"}}), ("b", {"P-2": {"overall": "some"}})):
        (tmp_path / folder).mkdir()
        for k, v in rows.items():
            (tmp_path / folder / f"{k}.json").write_text(json.dumps(v))
    read = lambda d: readers.json_records(spark, str(tmp_path / d), "overall string, tool string")
    got = readers.overridden(read("p"), read("b"), "source_id")
    assert sorted((r.source_id, r.overall, r.tool) for r in got.collect()) == [("P-1", "low", "a"), ("P-2", "some", "b")]


def test_html_leaves(spark):
    df = spark.createDataFrame([(1, '<li data-pid="P-1">One</li><li data-pid="P-2">Two</li><li>x</li>')], "k int, html string")
    assert [(r.value, r.text) for r in readers.html_leaves(df, "html", "li", "data-pid", ["k"]).collect()] == [("P-1", "One"), ("P-2", "Two")]


def test_identity_signals_to_components(spark, tmp_path):
    ready(spark)
    title = "A long title about early detection of decline"
    b = spark.createDataFrame([("P-1", title, "see 10.1000/abc."), ("P-2", title.upper(), ""), ("P-3", "Another quite different long title", "")], "pid string, title string, body string")
    r = spark.createDataFrame([("P-1", "doi:10.1000/abc"), ("P-2", None), ("P-3", "https://doi.org/10.1000/ABC")], "Paper_ID string, doi string")
    m = spark.createDataFrame([("P-1", "x/PMID_5_a.pdf", None)], "pid string, path string, map_doi string")
    s = readers.identity_signals(b, r, m)
    found = {(x.a, x.b): x.kinds for x in pairs.signal_pairs(s).collect()}
    assert found == {("P-1", "P-2"): ["title"], ("P-1", "P-3"): ["doi_field"]}
    c = graph.components(s.select(F.col("pid").alias("node")).distinct(), graph.star_edges(s))
    assert {x.component for x in c.collect()} == {"P-1"}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, f"a\r\nb{i}") for i in range(65)], "i int, t string")
    writers.append_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 65
    for _ in range(2):
        writers.overwrite_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 65
    writers.chunked(df, str(tmp_path / "k"), "i")
    assert {r.chunk: r["count"] for r in spark.read.json(str(tmp_path / "k")).groupBy("chunk").count().collect()} == {0: 30, 1: 30, 2: 5}


def test_stream_of_new_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"Paper_ID": "P-1", "n": 1}\n{"Paper_ID": "P-1", "n": 1}\n{"Paper_ID": "P-2", "n": 2}\n')
    rows = incremental.new_rows(spark, str(tmp_path / "in"), "Paper_ID string, n int")
    step = lambda d: d.withColumn("double", F.col("n") * 2)
    incremental.apply(rows, step, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    (tmp_path / "in" / "b.json").write_text('{"Paper_ID": "P-3", "n": 3}\n')
    incremental.apply(rows, step, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r.Paper_ID, r.double) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("P-1", 2), ("P-2", 4), ("P-3", 6)]


def test_paged_search_in_lines_and_folders(spark, tmp_path):
    pages = [(0, [1, 2]), (1, [3]), (2, [4]), (4, [5])] + [(n, [n]) for n in range(6, 3000)]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.json").write_text("".join(json.dumps({"page": n, "records": [{"k": k} for k in found]}) + "\n" for n, found in pages))
    got = paged.search(spark, str(tmp_path / "l"), "k bigint", lines=True)
    assert sorted((r.page, r.k) for r in got.collect()) == [(0, 1), (0, 2), (1, 3), (2, 4)]
    for n, found in pages[:5]:
        for part, k in enumerate(found):  # a page in two files is one page
            (tmp_path / "f" / f"page={n}").mkdir(parents=True, exist_ok=True)
            (tmp_path / "f" / f"page={n}" / f"{part}.json").write_text(json.dumps([{"k": k}]))
    got = paged.search(spark, str(tmp_path / "f"), "k bigint")
    assert sorted((r.page, r.k) for r in got.collect()) == [(0, 1), (0, 2), (1, 3), (2, 4)]
