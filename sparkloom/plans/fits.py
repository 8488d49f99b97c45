"""Fits as SQL: Newton steps as a chain of one-row tables, each solved by elimination; they check the estimators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort, estimators
from .reports import _t


def solved(source: str, p: int, name: str) -> str:
    """Tables that eliminate (h0_0.., g0.., identity) of ``source``: the last, ``name``, has step0.. and v0.. (diagonal of the inverse)."""
    cols = lambda i: [f"h{i}_{j}" for j in range(p)] + [f"g{i}"] + [f"i{i}_{j}" for j in range(p)]
    out, last = [], source
    for k in range(p):
        rows = [f"{c} / h{k}_{k} AS {c}" for c in cols(k)]
        for i in (x for x in range(p) if x != k):
            rows += [f"{c} - h{i}_{k} * ({d} / h{k}_{k}) AS {c}" for c, d in zip(cols(i), cols(k), strict=True)]
        out.append(f"{name}_{k} AS (SELECT {', '.join(rows)} FROM {last})")
        last = f"{name}_{k}"
    out.append(f"{name} AS (SELECT {', '.join(f'g{i} AS step{i}, i{i}_{i} AS v{i}' for i in range(p))} FROM {last})")
    return ",\n".join(out)


def logistic_sql(rows: str, xs: Sequence[str], ridge: Sequence[float], steps: int = 12) -> str:
    """``WITH d AS (rows: y, xs), ..., fit``: coefficients b0.. and errors v0.. after Newton steps from zero; ``ridge`` by coefficient."""
    p = len(xs)
    eta = " + ".join(f"b{j} * {x}" for j, x in enumerate(xs))
    parts = [f"d AS ({rows})", "t0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS b{j}" for j in range(p)) + ")"]
    for n in range(steps):
        h = [f"sum(m * (1 - m) * {xs[i]} * {xs[j]}) + {ridge[i] if i == j else 0}::DOUBLE AS h{i}_{j}" for i in range(p) for j in range(p)]
        g = [f"sum((y - m) * {x}) - {ridge[i]}::DOUBLE * any_value(b{i}) AS g{i}" for i, x in enumerate(xs)]
        one = [f"{1.0 if i == j else 0.0}::DOUBLE AS i{i}_{j}" for i in range(p) for j in range(p)]
        parts.append(f"s{n} AS (SELECT {', '.join(h + g + one)} FROM (SELECT d.*, t{n}.*, 1 / (1 + exp(-({eta}))) AS m FROM d, t{n}))")
        parts.append(solved(f"s{n}", p, f"z{n}"))
        parts.append(f"t{n + 1} AS (SELECT {', '.join(f't{n}.b{j} + step{j} AS b{j}, z{n}.v{j} AS v{j}' for j in range(p))} FROM t{n}, z{n})")
    return "WITH " + ",\n".join(parts)


def q_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge logistic of label < 5 on three embedding dimensions."""
    e = _t(spark, sf_dir, "embeddings").select((F.col("label") < 5).cast("double").alias("y"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(3)])
    out = estimators.logistic(e, "y", ["x0", "x1", "x2"])
    return out.select("term", F.round("estimate", 5).alias("estimate"), F.round("se", 5).alias("se"))


def q_cox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified Cox of the price on the days from order to a finished status, weighted."""
    o = _t(spark, sf_dir, "orders").select((F.datediff("o_orderdate", F.lit("1994-12-31")) % 400 + 1).cast("double").alias("t"), (F.col("o_orderstatus") == "F").cast("int").alias("e"), "o_orderpriority", (F.col("o_totalprice") / 1e5).alias("x"), (F.col("o_custkey") % 3 + 1).cast("double").alias("w"))
    out = estimators.cox(o, "t", "e", ["x"], "o_orderpriority", "w")
    return out.select("term", *[F.round(c, 6).alias(c) for c in ("estimate", "se", "hazard_ratio")])


def q_centre_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic with an intercept by market segment and one shared covariate, the ridge on all of them."""
    c = _t(spark, sf_dir, "customer").select((F.col("c_acctbal") > 4_500).cast("double").alias("y"), (F.col("c_nationkey") / 10.0).alias("x"), "c_mktsegment")
    beta, alpha = cohort.centre_logistic(c, "y", ["x"], "c_mktsegment")
    rows = [("x", float(beta[0])), *((k, float(v)) for k, v in sorted(alpha.items()))]
    return spark.createDataFrame(rows, "term string, estimate double").select("term", F.round("estimate", 6).alias("estimate"))


QUERIES = {f.__name__: f for f in (q_logit, q_cox, q_centre_logit)}

_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _cox_sql(steps: int = 10) -> str:
    parts = ["d AS (SELECT (date_diff('day', DATE '1994-12-31', o_orderdate::DATE) % 400 + 1)::DOUBLE AS t, (o_orderstatus = 'F')::INT AS e, o_orderpriority AS g, o_totalprice / 1e5::DOUBLE AS x, (o_custkey % 3 + 1)::DOUBLE AS w FROM orders)", "b0 AS (SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS h)"]
    for n in range(steps):
        parts.append(f"a{n} AS (SELECT g, t, any_value(b) AS b, sum(w * e) AS dd, sum(w * e * x) AS dx, sum(w * exp(b * x)) AS a0, sum(w * exp(b * x) * x) AS a1, sum(w * exp(b * x) * x * x) AS a2 FROM d, b{n} GROUP BY 1, 2)")
        parts.append(f"r{n} AS (SELECT b, dd, dx, sum(a0) OVER u AS s0, sum(a1) OVER u AS s1, sum(a2) OVER u AS s2 FROM a{n} WINDOW u AS (PARTITION BY g ORDER BY t DESC))")
        parts.append(f"b{n + 1} AS (SELECT any_value(b) + sum(dx - dd * s1 / s0) / sum(dd * (s2 / s0 - (s1 / s0) * (s1 / s0))) AS b, sum(dd * (s2 / s0 - (s1 / s0) * (s1 / s0))) AS h FROM r{n})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT 'x' AS term, round(b, 6) AS estimate, round(1 / sqrt(h), 6) AS se, round(exp(b), 6) AS hazard_ratio FROM b{steps}"


_LOGIT_X = ("one", "x0", "x1", "x2")
_CENTRE_X = ("x", *[f"d{i}" for i in range(5)])
SQL = {
    "q_logit": logistic_sql("SELECT (label < 5)::INT::DOUBLE AS y, 1.0::DOUBLE AS one, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS x1, embedding[3]::DOUBLE AS x2 FROM embeddings", _LOGIT_X, (0.0, 1e-6, 1e-6, 1e-6))
    + "\n" + " UNION ALL ".join(f"SELECT '{n}' AS term, round(b{j}, 5) AS estimate, round(sqrt(v{j}), 5) AS se FROM t12" for j, n in enumerate(("intercept", "x0", "x1", "x2"))),
    "q_cox": _cox_sql(),
    "q_centre_logit": logistic_sql("SELECT (c_acctbal > 4500)::INT::DOUBLE AS y, c_nationkey / 10.0::DOUBLE AS x, " + ", ".join(f"(c_mktsegment = '{s}')::INT::DOUBLE AS d{i}" for i, s in enumerate(_SEGMENTS)) + " FROM customer", _CENTRE_X, (1e-6,) * 6)
    + "\nSELECT 'x' AS term, round(b0, 6) AS estimate FROM t12 UNION ALL " + " UNION ALL ".join(f"SELECT '{s}', round(b{i + 1}, 6) FROM t12" for i, s in enumerate(_SEGMENTS)),
}
