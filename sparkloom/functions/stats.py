"""Closed-form statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> Column:
    """struct(p, low, high); nulls for n = 0."""
    k, n = k.cast("double"), F.when(n > 0, n.cast("double"))
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.struct(p.alias("p"), (mid - half).alias("low"), (mid + half).alias("high"))


def hanley_mcneil(auc: Column, n1: Column, n2: Column) -> Column:
    """Standard error of an AUC from n1 cases and n2 controls."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    return F.sqrt((auc * (1 - auc) + (n1 - 1) * (q1 - auc * auc) + (n2 - 1) * (q2 - auc * auc)) / (n1 * n2))


def binomial_se(p: Column, n: Column) -> Column:
    return F.sqrt(p * (1 - p) / n)


def balanced_accuracy_se(sens: Column, n1: Column, spec: Column, n0: Column) -> Column:
    return F.sqrt(sens * (1 - sens) / n1 + spec * (1 - spec) / n0) / 2


def z_score(a: Column, se_a: Column, b: Column, se_b: Column) -> Column:
    return F.try_divide(F.abs(a - b), F.sqrt(se_a * se_a + se_b * se_b))


def transport(sens: Column, spec: Column, prevalence: Column) -> Column:
    """Expected cells of 1 person, predictive values and false positives per true positive."""
    tp, fn = sens * prevalence, (1 - sens) * prevalence
    tn, fp = spec * (1 - prevalence), (1 - spec) * (1 - prevalence)
    ratio = F.when(tp > 0, fp / tp).when(fp > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.struct(tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"), F.try_divide(tp, tp + fp).alias("ppv"), F.try_divide(tn, tn + fn).alias("npv"), ratio.alias("fp_per_tp"))


def ctmc(a: Column, b: Column, c: Column, d: Column, t: Column) -> Column:
    """Transition matrix over time t of states 1, 2 and absorbing 3; rates 1->2 a, 1->3 b, 2->1 c, 2->3 d.

    The upper block's exponential is e^(mt) (cosh(st) I + t sinhc(st) (Q - m I)), which also holds as s tends to 0.
    """
    m, h = -(a + b + c + d) / 2, (c + d - a - b) / 2
    s = F.sqrt(h * h + a * c)
    sinhc = F.when(s * t > 1e-6, F.sinh(s * t) / s).otherwise(t * (1 + s * s * t * t / 6))
    grow = F.exp(m * t)
    p11, p22 = grow * (F.cosh(s * t) + h * sinhc), grow * (F.cosh(s * t) - h * sinhc)
    p12, p21 = grow * a * sinhc, grow * c * sinhc
    return F.struct(p11.alias("p11"), p12.alias("p12"), (1 - p11 - p12).alias("p13"), p21.alias("p21"), p22.alias("p22"), (1 - p21 - p22).alias("p23"))
