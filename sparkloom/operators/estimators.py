"""Estimators that keep data in Spark and solve small systems on the driver.

Every iteration is one pass of sums: what reaches the driver has the size of the parameters.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RIDGE = 1e-6


def sums(df: DataFrame, part: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """Sum over all rows of a vector that ``part`` makes of a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                v = np.asarray(part(b), float)
                total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

    rows = df.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["k"]] = r["v"]
    return out


def logistic(df: DataFrame, y: str, xs: Sequence[str], weight: str | None = None, ridge: float = RIDGE, steps: int = 50) -> DataFrame:
    """(term, estimate, se) of a ridge logistic; the intercept is not penalised. Newton with step halving."""
    p = len(xs) + 1
    pen = np.full(p, ridge)
    pen[0] = 0.0
    data = df.select(F.col(y).cast("double").alias("y"), *[F.col(x).cast("double") for x in xs], (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).na.drop().cache()
    try:

        def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            def part(b: pd.DataFrame) -> np.ndarray:
                x = np.column_stack([np.ones(len(b)), b[list(xs)].to_numpy()])
                eta, yy, w = x @ beta, b["y"].to_numpy(), b["w"].to_numpy()
                mu = 1 / (1 + np.exp(-eta))
                return np.concatenate([[(w * (yy * eta - np.logaddexp(0, eta))).sum()], x.T @ (w * (yy - mu)), ((x * (w * mu * (1 - mu))[:, None]).T @ x).ravel()])

            s = sums(data, part)
            if not len(s):
                return 0.0, np.zeros(p), np.zeros((p, p))
            return s[0] - 0.5 * (pen * beta * beta).sum(), s[1 : p + 1] - pen * beta, s[p + 1 :].reshape(p, p) + np.diag(pen)

        beta = np.zeros(p)
        value, grad, hess = at(beta)
        for _ in range(steps):
            step = np.linalg.lstsq(hess, grad, rcond=None)[0]
            size = 1.0
            while True:
                new = at(beta + size * step)
                if new[0] >= value - 1e-12 or size < 1e-6:
                    break
                size /= 2
            beta, (value, grad, hess) = beta + size * step, new
            if np.abs(size * step).max() < 1e-9:
                break
        se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(hess)), 0))
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame([(n, float(b), float(s)) for n, b, s in zip(["intercept", *xs], beta, se, strict=True)], "term string, estimate double, se double")


def cox(df: DataFrame, time: str, event: str, xs: Sequence[str], stratum: str | None = None, weight: str | None = None, steps: int = 30) -> DataFrame:
    """(term, estimate, se) of a weighted stratified Cox model with Breslow ties.

    Rows are summed by stratum and time; risk sets are reverse running sums over those, so a step costs one
    shuffle of distinct times.
    """
    p = len(xs)
    rows = df.select(F.col(time).alias("t"), F.col(event).cast("double").alias("e"), *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)], (F.col(stratum) if stratum else F.lit(0)).alias("s"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).cache()
    try:
        order = Window.partitionBy("s").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        pairs = [(i, j) for i in range(p) for j in range(i, p)]

        def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            eta = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))
            r = F.col("w") * F.exp(eta)
            d = F.col("w") * F.col("e")
            by = rows.groupBy("s", "t").agg(
                F.sum(r).alias("s0"), *[F.sum(r * F.col(f"x{i}")).alias(f"a{i}") for i in range(p)], *[F.sum(r * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"b{i}_{j}") for i, j in pairs],
                F.sum(d).alias("d"), F.sum(d * eta).alias("de"), *[F.sum(d * F.col(f"x{i}")).alias(f"d{i}") for i in range(p)],
            )
            names = ["s0", *[f"a{i}" for i in range(p)], *[f"b{i}_{j}" for i, j in pairs]]
            run = by.select("d", "de", *[f"d{i}" for i in range(p)], *[F.sum(n).over(order).alias(n) for n in names]).where("d > 0")
            mean = lambda i: F.col(f"a{i}") / F.col("s0")
            out = run.agg(
                F.sum(F.col("de") - F.col("d") * F.ln("s0")), *[F.sum(F.col(f"d{i}") - F.col("d") * mean(i)) for i in range(p)],
                *[F.sum(F.col("d") * (F.col(f"b{i}_{j}") / F.col("s0") - mean(i) * mean(j))) for i, j in pairs],
            ).first()
            v = [float(x or 0.0) for x in out]
            hess = np.zeros((p, p))
            for (i, j), h in zip(pairs, v[p + 1 :], strict=True):
                hess[i, j] = hess[j, i] = h
            return v[0], np.array(v[1 : p + 1]), hess

        beta = np.zeros(p)
        value, grad, hess = at(beta)
        for _ in range(steps):
            step = np.linalg.lstsq(hess, grad, rcond=None)[0]
            size = 1.0
            while True:
                new = at(beta + size * step)
                if new[0] >= value - 1e-10 or size < 1e-6:
                    break
                size /= 2
            beta, (value, grad, hess) = beta + size * step, new
            if np.abs(size * step).max() < 1e-9:
                break
        se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(hess)), 0))
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame([(n, float(b), float(s), math.exp(b)) for n, b, s in zip(xs, beta, se, strict=True)], "term string, estimate double, se double, hazard_ratio double")


# Bounds and starts of the four rates (1 to 2, 1 to 3, 2 to 1, 2 to 3).
LOW, HIGH = math.log(1e-6), math.log(2.0)
STARTS = ((0.04, 0.003, 0.05, 0.10), (0.10, 0.01, 0.10, 0.20), (0.01, 0.001, 0.02, 0.05))


def transition(rates: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Transition matrices (n x 3 x 3) of two transient states and an absorbing one over times t."""
    a, b, c, d = rates
    t = np.asarray(t, float)
    m, h = -(a + b + c + d) / 2, (c + d - a - b) / 2
    s = math.sqrt(h * h + a * c)
    grow, cosh = np.exp(m * t), np.cosh(s * t)
    sinhc = np.where(s * t > 1e-6, np.sinh(s * t) / max(s, 1e-300), t * (1 + (s * t) ** 2 / 6))
    out = np.zeros((len(t), 3, 3))
    out[:, 0, 0], out[:, 0, 1] = grow * (cosh + h * sinhc), grow * a * sinhc
    out[:, 1, 0], out[:, 1, 1] = grow * c * sinhc, grow * (cosh - h * sinhc)
    out[:, :2, 2] = 1 - out[:, :2, :2].sum(axis=2)
    out[:, 2, 2] = 1
    return out


def _climb(values, xs: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(points, values) that projected Newton steps reach from each start within the bounds; ``values`` takes many points in one pass.

    All starts move in the same passes. Slopes come from a stencil around each point, moved inward at a bound.
    """
    p, h = xs.shape[1], 1e-4
    eye = np.eye(p) * h
    above = [(i, j) for i in range(p) for j in range(i + 1, p)]
    xs = np.clip(xs, low, high)
    value, live = np.full(len(xs), -np.inf), np.ones(len(xs), bool)
    for _ in range(steps):
        on = np.flatnonzero(live)
        if not len(on):
            break
        centre = np.clip(xs, low + h, high - h)
        stencil = np.array([[x, *(c + e for e in eye), *(c - e for e in eye), *(c + eye[i] + eye[j] for i, j in above), c] for x, c in zip(xs[on], centre[on], strict=True)])
        f = values(stencil.reshape(-1, p))
        f = f.reshape(len(on), -1) if len(f) else np.zeros(stencil.shape[:2])
        moves = np.zeros((len(on), 12, p))
        for k, o in enumerate(on):
            x, mid = xs[o], f[k, -1]
            up, down = f[k, 1 : p + 1], f[k, p + 1 : 2 * p + 1]
            g = (up - down) / (2 * h)
            value[o] = f[k, 0]
            hess = np.diag((up + down - 2 * mid) / h**2)
            for m, (i, j) in enumerate(above):
                hess[i, j] = hess[j, i] = (f[k, 2 * p + 1 + m] - up[i] - up[j] + mid) / h**2
            free = ~((x <= low + 1e-12) & (g < 0) | (x >= high - 1e-12) & (g > 0))
            step = np.zeros(p)
            if free.any():
                w, v = np.linalg.eigh(-hess[np.ix_(free, free)])
                step[free] = v @ ((v.T @ g[free]) / np.maximum(np.abs(w), 1e-6))
            moves[k] = np.clip(x + 2.0 ** -np.arange(12)[:, None] * np.clip(step, -2, 2), low, high)
        got = values(moves.reshape(-1, p))
        got = got.reshape(len(on), 12) if len(got) else np.zeros((len(on), 12))
        for k, o in enumerate(on):
            m = int(np.argmax(got[k]))
            if got[k, m] <= value[o] + 1e-10 * max(1, abs(value[o])):
                live[o] = False
            else:
                xs[o], value[o] = moves[k, m], got[k, m]
    return xs, value


def _panel_values(data: DataFrame, to_rates):
    """Log-likelihood of a panel at many points, summed in one pass."""

    def values(points: np.ndarray) -> np.ndarray:
        def part(b: pd.DataFrame) -> np.ndarray:
            i, j, n = b["s0"].to_numpy() - 1, b["s1"].to_numpy() - 1, b["n"].to_numpy()
            at = np.arange(len(b))
            return np.array([(n * np.log(np.maximum(transition(to_rates(q), b["dt"].to_numpy())[at, i, j], 1e-300))).sum() for q in points])

        return sums(data, part)

    return values


def _panel(panel: DataFrame) -> DataFrame:
    return panel.select(F.col("dt").cast("double"), F.col("s0").cast("int"), F.col("s1").cast("int"), F.col("n").cast("double")).cache()


def ctmc(panel: DataFrame, starts: Sequence[Sequence[float]] = STARTS, steps: int = 40) -> DataFrame:
    """(rate, estimate, at_bound, loglik) by projected Newton on log rates over a panel (dt, s0, s1, n)."""
    data = _panel(panel)
    try:
        xs, value = _climb(_panel_values(data, np.exp), np.log(np.array(starts, float)), np.full(4, LOW), np.full(4, HIGH), steps)
    finally:
        data.unpersist()
    rates, best = np.exp(xs[int(np.argmax(value))]), float(value.max())
    names = ("r12", "r13", "r21", "r23")
    return panel.sparkSession.createDataFrame([(n, float(r), bool(r <= 1.01e-6 or r >= 1.999), best) for n, r in zip(names, rates, strict=True)], "rate string, estimate double, at_bound boolean, loglik double")


def ctmc_boundary(panel: DataFrame, starts: Sequence[Sequence[float]] = STARTS, steps: int = 40, horizon: float = 4.0) -> DataFrame:
    """(mode, r12, r13, r21, r23, loglik, to_first, to_end): the fit with the direct rate bounded away from zero, fixed at zero, and free from zero on.

    ``to_first`` and ``to_end`` are the chances to be in states 1 and 3 a horizon after state 2.
    """
    data, rows = _panel(panel), []
    start = np.array(starts, float)
    try:
        for mode in ("original_bound", "fixed_zero", "free_nonnegative"):
            if mode == "fixed_zero":
                to_rates = lambda q: np.array([np.exp(q[0]), 0.0, np.exp(q[1]), np.exp(q[2])])
                xs, low, high = np.log(start[:, [0, 2, 3]]), np.full(3, LOW), np.full(3, HIGH)
            elif mode == "free_nonnegative":
                to_rates = lambda q: np.array([np.exp(q[0]), q[1], np.exp(q[2]), np.exp(q[3])])
                xs, low, high = np.log(start), np.array([LOW, 0.0, LOW, LOW]), np.array([HIGH, 2.0, HIGH, HIGH])
                xs[:, 1] = start[:, 1]
            else:
                to_rates, xs, low, high = np.exp, np.log(start), np.full(4, LOW), np.full(4, HIGH)
            xs, value = _climb(_panel_values(data, to_rates), xs, low, high, steps)
            rates = to_rates(xs[int(np.argmax(value))])
            after = transition(rates, np.array([horizon]))[0]
            rows.append((mode, *map(float, rates), float(value.max()), float(after[1, 0]), float(after[1, 2])))
    finally:
        data.unpersist()
    return panel.sparkSession.createDataFrame(rows, "mode string, r12 double, r13 double, r21 double, r23 double, loglik double, to_first double, to_end double")


def kappa(n00: float, n01: float, n10: float, n11: float) -> float:
    n = n00 + n01 + n10 + n11
    if not n:
        return math.nan
    po, pe = (n00 + n11) / n, ((n00 + n01) * (n00 + n10) + (n10 + n11) * (n01 + n11)) / n / n
    return (po - pe) / (1 - pe) if pe < 1 else math.nan


def kappa_bootstrap(df: DataFrame, a: str, b: str, draws: int = 2000, seed: int = 1) -> DataFrame:
    """(kappa, low, high, valid): resampling rows is a multinomial draw over the four cells, so only their counts are needed."""
    c = df.agg(*[F.count_if((F.col(a) == i) & (F.col(b) == j)) for i in (0, 1) for j in (0, 1)]).first()
    n = sum(c)
    rng = np.random.default_rng(seed)
    tries = [kappa(*x) for x in rng.multinomial(n, np.array(c) / n, size=draws)] if n else []
    good = sorted(k for k in tries if not math.isnan(k))
    low, high = (float(good[int(0.025 * len(good))]), float(good[max(int(0.975 * len(good)) - 1, 0)])) if good else (None, None)
    k = kappa(*c)
    return df.sparkSession.createDataFrame([(None if math.isnan(k) else float(k), low, high, len(good))], "kappa double, low double, high double, valid int")


def order_statistic_interval(labels: Sequence[tuple[int, int]], draws: int = 2000, seed: int = 1) -> tuple[float, float]:
    """Row resampling with Python's own generator, for lists that fit in memory: the draws of a fixed seed can be repeated elsewhere."""
    rng, n, out = random.Random(seed), len(labels), []
    for _ in range(draws):
        s = [labels[rng.randrange(n)] for _ in range(n)]
        k = kappa(*[sum(x == (i, j) for x in s) for i in (0, 1) for j in (0, 1)])
        if not math.isnan(k):
            out.append(k)
    out.sort()
    return out[int(0.025 * len(out))], out[int(0.975 * len(out)) - 1]


def selection_weights(df: DataFrame, probability: str, selected: str, low: float | None = 0.01, high: float | None = 0.99) -> DataFrame:
    """Stabilised weights of selected rows: prevalence / probability, winsorised at raw quantiles, then scaled to mean 1."""
    share = df.agg(F.avg(F.col(selected).cast("double")).alias("share"))
    raw = df.where(F.col(selected).cast("boolean")).crossJoin(F.broadcast(share)).withColumn("_raw", F.col("share") / F.col(probability))
    if low is not None and high is not None:
        q = raw.agg(F.percentile("_raw", F.array(F.lit(low), F.lit(high))).alias("q"))
        raw = raw.crossJoin(F.broadcast(q)).withColumn("_raw", F.least(F.greatest("_raw", F.col("q")[0]), F.col("q")[1])).drop("q")
    mean = raw.agg(F.avg("_raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("_raw") / F.col("mean")).drop("_raw", "share", "mean")


def multiplicities(df: DataFrame, unit: str, reps: int, seed: int) -> DataFrame:
    """(rep, unit, m): Poisson bootstrap counts of each unit, from hashes, so that any split of the data draws the same."""
    u = F.pmod(F.xxhash64(unit, "rep", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    total, m = 0.0, F.lit(0)
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        m = m + F.when(u >= total, 1).otherwise(0)
    units = df.select(unit).distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return units.withColumn("m", m).where("m > 0")
