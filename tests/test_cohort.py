import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import cohort
from sparkloom.session import ready


def test_trajectories_keep_the_baseline_rule(spark):
    d = dt.date
    rows = [(1, d(2020, 1, 1), 1, True), (1, d(2021, 1, 1), 2, False), (1, d(2021, 1, 1), 3, False), (1, d(2022, 1, 1), 2, False), (2, d(2020, 5, 1), 1, False), (3, d(2019, 1, 1), 2, False), (3, d(2020, 1, 1), 1, True)]
    v = spark.createDataFrame(rows, "p int, day date, state int, bl boolean")
    got = sorted((r.p, round(r.t, 6), r.state) for r in cohort.trajectories(v, "p", F.col("bl")).collect())
    assert got == [(1, 0.0, 1), (1, round(731 / 365.25, 6), 2), (3, 0.0, 1)]


def test_policies_and_outcome(spark):
    df = spark.createDataFrame([("yes", 1.0, 5.0), ("1.0", 5.0, 6.0), (None, None, 2.0), ("0", 0.0, 0.0)], "q string, t double, f double")
    assert [r[0] for r in df.select(cohort.failed_qc(F.col("q"))).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(cohort.failed_qc(F.col("q"), "number")).collect()] == [False, True, False, False]
    t, e = cohort.outcome(F.col("t"), F.col("f"), 4.0)
    assert [tuple(r) for r in df.select(t, e).collect()] == [(1.0, 1), (4.0, 0), (2.0, 0), (0.0, 0)]


def test_schedules(spark):
    got = {r.interval: (r.follow_ups, r.n) for r in cohort.schedules(spark, [6, 12, 24, 48, 72]).collect()}
    assert [got[k][1] for k in (6, 12, 24, 48, 72)] == [10, 5, 2, 1, 0] and got[24][0] == "24;48"


def test_differences(spark):
    df = spark.createDataFrame([("a", 53.0, 99.8), ("b", 56.0, 97.4), ("c", 82.11, 97.07)], "s string, strict double, loose double")
    assert [r.difference for r in cohort.evidence_differences(df, "s", "strict", "loose").collect()] == [46.8, 41.4, 14.96]


def test_centre_logistic_against_dense(spark):
    rng = np.random.default_rng(2)
    n, k = 400, 4
    c, x = rng.integers(0, k, n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(np.array([-1, 0, 0.5, 1])[c] + 0.8 * x)))).astype(float)
    beta, alpha = cohort.centre_logistic(spark.createDataFrame(pd.DataFrame({"c": c, "x": x, "y": y})), "y", ["x"], "c")
    d, b = np.column_stack([np.eye(k)[c], x]), np.zeros(k + 1)
    for _ in range(40):
        mu = 1 / (1 + np.exp(-d @ b))
        b += np.linalg.solve((d * (mu * (1 - mu))[:, None]).T @ d + 1e-6 * np.eye(k + 1), d.T @ (y - mu) - 1e-6 * b)
    assert beta[0] == pytest.approx(b[-1], abs=1e-5) and [alpha[i] for i in range(k)] == pytest.approx(list(b[:k]), abs=1e-5)


def test_paired_bootstrap(spark):
    ready(spark)
    rows = [(p, float(t), s) for p in range(40) for t, s in ((0, 1), (1, 2 if p % 2 else 1), (2, 1), (4, 3))]
    v = spark.createDataFrame(rows, "p int, t double, state int")
    got = {r.schedule: r for r in cohort.paired_bootstrap(v, "p", "p", [("four", 4.0, 0.5)], 60).collect()}
    assert got["full"].estimate == 0.5 and got["four"].estimate == 1.0
    assert got["full"].difference_low == got["full"].difference_high == 0.0 and 0.2 < got["four"].difference_low < 0.5 < got["four"].difference_high < 0.8
