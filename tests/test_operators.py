import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import aggregates, estimators, graph, lint, longitudinal, merge, pairs, selection
from sparkloom.session import ready


@pytest.fixture(autouse=True)
def _ready(spark):
    ready(spark)


def got(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def series(spark, t, s):
    return spark.createDataFrame([(1, float(x), y) for x, y in zip(t, s, strict=True)], "p int, t double, s int")


def test_mask_visits(spark):
    v = series(spark, range(5), [1, 2, 1, 2, 3])
    assert got(longitudinal.mask_visits(v, "p", "t", 4.0, 0.5).select("t", "s"), "t") == [(0.0, 1), (4.0, 3)]
    v = series(spark, range(2), [2, 1])
    assert got(longitudinal.mask_visits(v, "p", "t", 4.0, 0.5, terminal=False).select("t", "s"), "t") == [(0.0, 2)]


def test_cumulative_incidence(spark):
    r = spark.createDataFrame([(1.0, 1), (1.0, 2), (2.0, None), (0.0, None)], "time double, event int")
    c = longitudinal.at_horizons(longitudinal.cumulative_incidence(r), [1, 2])
    assert [(e, round(a, 6), round(b, 6)) for e, a, b in got(c, "event")] == [(1, round(1 / 3, 6), round(1 / 3, 6)), (2, round(1 / 3, 6), round(1 / 3, 6))]


def test_as_of_skips_nulls_and_the_future(spark):
    left = spark.createDataFrame([(1, 5), (1, 9), (2, 5)], "k int, at int")
    right = spark.createDataFrame([(1, 4, "a", None), (1, 5, None, 7), (1, 10, "z", 9)], "k int, t int, x string, y int")
    assert got(longitudinal.as_of(left, right, "k", "at", "t", ["x", "y"]), "k", "at") == [(1, 5, "a", 7), (1, 9, "a", 7), (2, 5, None, None)]


def test_three_way(spark):
    make = lambda rows: spark.createDataFrame(rows, "id int, a string, b string")
    base, ours = make([(1, "x", "y"), (2, "x", "y"), (3, "x", "y")]), make([(1, "ours", "y"), (3, "x", "y"), (9, "new", "new")])
    disk = make([(1, "x", "disk"), (2, "x", "y"), (3, "disk", "y"), (8, "d", "d")])
    assert got(merge.three_way(base, ours, disk, "id"), "id") == [(1, "ours", "disk"), (3, "disk", "y"), (8, "d", "d"), (9, "new", "new")]


def test_edits_and_diff(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, x string, n int")
    edits = spark.createDataFrame([(2, "n", "7"), (2, "x", None)], "id int, column string, value string")
    out = merge.apply_edits(df, edits, "id")
    assert got(out, "id") == [(1, "a", 5), (2, None, 7)]
    assert got(merge.exact_diff(df, out), "side") == [(2, None, 7, "added"), (2, "b", 6, "removed")]


def test_next_ids(spark):
    old = spark.createDataFrame([("G-07",), ("G-99",), ("X-1",)], "id string")
    new = spark.createDataFrame([("a", ""), ("b", "")], "n string, id string")
    assert got(merge.next_ids(old, new, "id", "G-", ["n"]), "n") == [("a", "G-100"), ("b", "G-101")]


def test_repair_and_missing_ids(spark):
    df = spark.createDataFrame([(1, ["a", "q", "b"]), (2, [])], "k int, refs array<string>")
    assert got(lint.repair_ids(df, "refs", spark.createDataFrame([("a",), ("b",)], "v string"), "k").select("k", "refs"), "k") == [(1, ["a", "UNRESOLVED", "b"]), (2, [])]
    ids = spark.createDataFrame([(3,), (5,), (5,), (9,), (200_001,)], "k bigint").where("k < 100 or k > 0")
    assert lint.missing_ids(ids, "k").count() == 200_001 - 3 + 1 - 4


def test_stop_on(spark):
    found = lint.lint(spark.createDataFrame([(1, -1), (2, 5)], "k int, n int"), ["k"], {"negative": F.col("n") < 0})
    assert lint.stop_on(found, []) == 1
    with pytest.raises(ValueError):
        lint.stop_on(found, ["negative"])


def test_components_lexicographic(spark):
    nodes = spark.createDataFrame([("P-10",), ("P-2",), ("P-3",), ("P-4",)], "node string")
    edges = spark.createDataFrame([("P-10", "P-2"), ("P-3", "P-2")], "src string, dst string")
    assert got(graph.components(nodes, edges), "node") == [("P-10", "P-10"), ("P-2", "P-10"), ("P-3", "P-10"), ("P-4", "P-4")]


def test_duplicate_classes(spark):
    rows = [(True, 1.0, True, []), (True, 0.95, False, []), (True, None, False, []), (True, 0.2, False, []), (False, None, False, ["map_doi"]), (False, None, False, ["doi_field"]), (False, 1.0, False, ["title"])]
    df = spark.createDataFrame(rows, "anchored boolean, similarity double, stubbed boolean, kinds array<string>")
    assert [r["class"] for r in graph.classify(df).collect()] == ["duplicate_stubbed", "duplicate", "anchor_unverified", "map_conflict", "map_doi_collision", "doi_field_collision", "title_only_collision"]


def test_direction_pairs(spark):
    rows = [("P-1", "t", "improves", True, ["a", "b"]), ("P-2", "t", "worsens", False, ["a", "b", "c"]), ("P-3", "t", "null", False, ["z"])]
    df = spark.createDataFrame(rows, "paper string, topic string, direction string, significant boolean, tokens array<string>")
    assert [(r.a_paper, r.b_paper, r.kind, r.n) for r in pairs.direction_pairs(df).collect()] == [("P-1", "P-2", "opposite", 1)]


def exchanged(df):
    """Bytes written to shuffles by running a query."""
    total = lambda: df.sparkSession.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


def test_direction_pairs_of_copies_and_of_papers_with_many_atoms(spark):
    rows = [(i, "t", ("improves", "worsens")[i % 2], False, ["a", "b", "c"]) for i in range(1200)]
    df = spark.createDataFrame(rows, "paper int, topic string, direction string, significant boolean, tokens array<string>")
    found = pairs.direction_pairs(df)
    assert found.count() == found.select("a_paper", "b_paper").distinct().count() == found.where("a_paper < b_paper and a_direction <> b_direction and n = 1").count() == 600 * 600
    assert exchanged(found) < 200_000  # the pairs are not exchanged
    rng = np.random.default_rng(5)
    names = [*pairs.NULLS, *pairs.NULLS.values(), "other"]
    rows = [(int(rng.integers(60)), f"t{rng.integers(3)}", names[rng.integers(len(names))], bool(rng.integers(2)), sorted({str(t) for t in rng.integers(6, size=3)})) for _ in range(220)]
    sign = {frozenset(x): "opposite" for x in pairs.OPPOSITES}
    best = {}
    for p, t, d, s, w in rows:
        for q, u, e, z, v in rows:
            if p < q and t == u:
                near = len(set(w) & set(v)) / len(set(w) | set(v))
                kind = "opposite" if sign.get(frozenset((d, e))) and near >= 0.15 else "null" if ((pairs.NULLS.get(d) == e and s) or (pairs.NULLS.get(e) == d and z)) and near >= 0.30 else None
                if kind:
                    best.setdefault((p, q), []).append((kind != "opposite", -near, t, d, e, kind))
    want = {(*k, min(v)[5], len(v), round(-min(v)[1], 6), min(v)[3], min(v)[4]) for k, v in best.items()}
    found = pairs.direction_pairs(spark.createDataFrame(rows, df.schema)).collect()
    assert len(found) == len(want) > 100
    assert {(r.a_paper, r.b_paper, r.kind, r.n, round(r.similarity, 6), r.a_direction, r.b_direction) for r in found} == want


def test_complements_of_copies(spark):
    """Papers alike meet as packs, all their pairs are written out, the lesser key first."""
    kinds = [("x", ["n1"], ["a", "b", "c", "d"]), ("y", ["n2"], ["a", "b", "e", "f"]), ("x", ["n1"], ["g", "h", "i", "j"])]
    rows = [(i, "t", kinds[i % 3][1], f"arch{i % 3}", kinds[i % 3][2], kinds[i % 3][2], ["a", "b"]) for i in range(1800)]
    df = spark.createDataFrame(rows, "k int, task string, nodes array<string>, arch string, tokens array<string>, findings array<string>, limits array<string>")
    packed = pairs.packs(df, "k", ["task"], ["nodes", "arch", "tokens", "findings", "limits"])
    assert sorted(len(r["keys"]) for r in packed.collect()) == [100, 100, 100, 500, 500, 500]
    assert pairs.pack_pairs(packed, ["task"]).count() <= 36  # not 1,800 times 1,799 / 2
    found = pairs.complements(df, "k", ["task"], "nodes", "arch", "tokens", "findings", "limits", least_tokens=2)
    want = {(i, j) for i in range(1800) for j in range(i + 1, 1800) if i % 3 != j % 3}
    pairs_found = [(r.a_k, r.b_k) for r in found.select("a_k", "b_k").collect()]
    assert len(pairs_found) == len(want) and set(pairs_found) == want
    none = pairs.complements(df, "k", ["task"], "nodes", "arch", "tokens", "findings", "limits", least_tokens=2, blocked=found.select(F.col("a_k").alias("a"), F.col("b_k").alias("b")))
    assert none.count() == 0


def test_best_match_of_copies(spark):
    """Statements and records alike are compared once; ties go to the first record, one row a statement."""
    said = spark.createDataFrame([(i, "b", ["a", "b"] if i % 2 else ["c"]) for i in range(3000)] + [(9000, "b", ["zz"]), (9001, "none", ["a"])], "s int, block string, tokens array<string>")
    known = spark.createDataFrame([(i, "b", ["a", "b", "d"] if i % 2 else ["c", "d"]) for i in range(7, 3000)], "k int, block string, tokens array<string>")
    found = selection.best_match(said, known, "block", "tokens", "k")
    assert {(r.s, r.match, round(r.similarity, 3)) for r in found.collect()} == {(i, 7, 0.667) if i % 2 else (i, 8, 0.5) for i in range(3000)} and found.count() == 3000
    said, known = said.where("s < 9000"), known.withColumn("k", F.col("k") + 0)
    assert most_rows(selection.best_match(said, known, "block", "tokens", "k")) < 30_000  # not 3,000 times 2,993


def test_signal_pairs_write_pairs_once_without_an_exchange(spark):
    """Ids with many values of a kind, and one large group: every pair once, with all its kinds."""
    rng = np.random.default_rng(8)
    rows = [(f"p{rng.integers(80)}", f"k{rng.integers(3)}", None if v > 25 else f"v{v}") for v in rng.integers(30, size=240)]
    df = spark.createDataFrame(rows, "pid string, kind string, value string")
    want = {}
    for p, k, v in rows:
        for q, m, w in rows:
            if p < q and k == m and v == w and v is not None:
                want.setdefault((p, q), set()).add(k)
    found = pairs.signal_pairs(df).collect()
    assert len(found) == len(want) and {(r.a, r.b): r.kinds for r in found} == {k: sorted(v) for k, v in want.items()}
    hot = spark.createDataFrame([(f"p{i}", k, "x") for i in range(900) for k in ("doi", "title")], df.schema)
    found = pairs.signal_pairs(hot, ["title"])
    assert found.where("size(kinds) = 2 and a_title = b_title").count() == 900 * 899 // 2
    assert exchanged(found) < 400_000
    assert pairs.signal_pairs(df.where("false"), ["title"]).count() == 0


def test_known_titles_inside_others(spark):
    """A title's first signs count wherever they begin, also within a word; titles that begin alike meet by all of their signs."""
    deep = "deep networks that read images of older adults in clinics of many towns and of rural places"
    files = spark.createDataFrame([("f1", "10.1/a", "s1", deep), ("f2", None, "s2", deep[:45]), ("f3", None, "s3", deep[:40]), ("f4", None, "s4", "x" * 50 + " one two")], "file string, doi string, stem string, title string")
    titles = spark.createDataFrame([("P-1", "meta" + deep[:70] + " again"), ("P-2", "on " + deep), ("P-3", "a" + "x" * 50 + " one two three"), ("P-4", deep[:60] + " of other things that nobody read")], "pid string, title string")
    none = spark.createDataFrame([], "doi string, pid string")
    found = pairs.known_already(files, none, none.select("doi"), none.select(F.col("pid").alias("stem")), titles)
    assert {r.file: r.reasons for r in found.collect()} == {"f1": "title=P-1", "f2": "title=P-1", "f3": "", "f4": "title=P-3"}
    many = spark.createDataFrame([(f"P-{i}", f"deep networks that read type{i} images of older adults in clinics of many towns") for i in range(3000)], "pid string, title string")
    found = pairs.known_already(many.selectExpr("replace(pid, 'P', 'f') file", "cast(null as string) doi", "pid stem", "title"), none, none.select("doi"), none.select(F.col("pid").alias("stem")), many)
    assert found.where("reasons = concat('title=', replace(file, 'f', 'P'))").count() == 3000


def most_rows(df):
    """The most rows that a join of the query puts out."""
    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        kids = node.children()
        own = node.metrics().apply("numOutputRows").value() if "Join" in name else 0
        return max([own, *[walk(kids.apply(i)) for i in range(kids.size())]])

    plan = df._jdf.queryExecution()
    df._jdf.collectToPython()
    return walk(plan.executedPlan())


def test_greedy_select_is_order_free(spark):
    rows = [("p", 3, ["a", "b"]), ("p", 1, ["a", "b"]), ("p", 2, ["c"]), ("q", 1, [])]
    df = spark.createDataFrame(rows, "k string, o int, t array<string>")
    want = [("p", 1), ("p", 2), ("q", 1)]
    assert got(selection.greedy_select(df, "k", "o", "t").select("k", "o"), "k", "o") == want
    assert got(selection.greedy_select(spark.createDataFrame(rows[::-1], df.schema), "k", "o", "t").select("k", "o"), "k", "o") == want


def test_kappa(spark):
    df = spark.createDataFrame([(1, 1)] * 5 + [(0, 0)] * 3 + [(1, 0)] * 2, "a int, b int")
    r = aggregates.confusion(df, "a", "b").first()
    assert r["kappa"] == pytest.approx(estimators.kappa(3, 0, 2, 5))
    assert aggregates.confusion(df.where("a = 1 and b = 1"), "a", "b").first()["kappa"] is None


def test_logistic_against_dense_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.4 + x @ [1.0, -0.7])))).astype(float)
    out = estimators.logistic(spark.createDataFrame(pd.DataFrame({"y": y, "a": x[:, 0], "b": x[:, 1]})), "y", ["a", "b"]).toPandas()
    d, beta = np.column_stack([np.ones(300), x]), np.zeros(3)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-d @ beta))
        beta += np.linalg.solve((d * (mu * (1 - mu))[:, None]).T @ d + np.diag([0, 1e-6, 1e-6]), d.T @ (y - mu) - np.array([0, 1e-6, 1e-6]) * beta)
    assert np.allclose(out["estimate"], beta, atol=1e-6)


def test_cox_weights_equal_replication(spark):
    rng = np.random.default_rng(5)
    f = pd.DataFrame({"t": rng.integers(1, 9, 60).astype(float), "e": rng.integers(0, 2, 60), "x": rng.normal(size=60), "s": rng.integers(0, 2, 60), "w": rng.integers(1, 4, 60).astype(float)})
    one = estimators.cox(spark.createDataFrame(f), "t", "e", ["x"], "s", "w").first()
    two = estimators.cox(spark.createDataFrame(f.loc[f.index.repeat(f["w"].astype(int))].drop(columns="w")), "t", "e", ["x"], "s").first()
    assert one["estimate"] == pytest.approx(two["estimate"], abs=2e-6)


def test_ctmc_recovers_rates(spark):
    rates, rng, rows = np.array([0.3, 0.05, 0.4, 0.2]), np.random.default_rng(1), []
    for dt in (0.5, 1.0, 2.0):
        p = estimators.transition(rates, np.array([dt]))[0]
        rows += [(dt, s0, s1, int(n)) for s0 in (1, 2) for s1, n in zip((1, 2, 3), rng.multinomial(20_000, p[s0 - 1]), strict=True)]
    out = estimators.ctmc(spark.createDataFrame(rows, "dt double, s0 int, s1 int, n bigint"), starts=[(0.1, 0.1, 0.1, 0.1)]).toPandas()
    assert np.abs(out["estimate"] / rates - 1).max() < 0.15
    assert not out["at_bound"].any()


def test_selection_weights_mean_one(spark):
    df = spark.createDataFrame([(i, (i % 7 + 1) / 10, i % 3 > 0) for i in range(90)], "i int, p double, sel boolean")
    w = estimators.selection_weights(df, "p", "sel")
    assert w.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)


def test_boundary_fits(spark):
    """Panels of a known generator without a direct rate: the three parameterisations agree, and the free one finds the zero."""
    rates, rows = np.array([0.2, 0.0, 0.3, 0.15]), []
    for dt in (0.5, 1.0, 2.0):
        p = estimators.transition(rates, np.array([dt]))[0]
        rows += [(dt, i + 1, j + 1, float(round(1e5 * p[i, j], 6))) for i in range(2) for j in range(3)]
    fits = {r["mode"]: r for r in estimators.ctmc_boundary(spark.createDataFrame(rows, "dt double, s0 int, s1 int, n double")).collect()}
    for r in fits.values():
        assert abs(r["r12"] - 0.2) < 2e-3 and abs(r["r21"] - 0.3) < 2e-3 and abs(r["r23"] - 0.15) < 2e-3 and r["r13"] < 1e-3
        assert abs(r["to_first"] - estimators.transition(rates, np.array([4.0]))[0][1, 0]) < 2e-3
    assert fits["fixed_zero"]["r13"] == 0 and fits["free_nonnegative"]["loglik"] >= fits["fixed_zero"]["loglik"] - 1e-7 * abs(fits["fixed_zero"]["loglik"])


def test_greedy_keeps_no_group_in_memory(spark):
    rows = [(k % 2, i, [f"w{i // 2}", "x"]) for i, k in enumerate(range(400))]
    df = spark.createDataFrame(rows, "key int, o int, tokens array<string>").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = sorted((r.key, r.o) for r in selection.greedy_select(df, "key", "o", "tokens", 3, 0.9).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(0, 0), (0, 2), (0, 4), (1, 1), (1, 3), (1, 5)]


def test_numbering_follows_the_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(9)
    assert [r.v for r in merge.numbered(df, ["v"]).orderBy("number").collect()] == sorted(i * 7919 % 5003 for i in range(5000))
    assert merge.numbered(df.limit(0), ["v"]).count() == 0
