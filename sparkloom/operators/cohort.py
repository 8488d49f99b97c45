"""Cohort assembly and exposure analysis: valid visits, baselines, covariates, outcomes, schedules, weighted models, bootstrap."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import transport
from . import aggregates, estimators, longitudinal

DAYS = 365.25
# Source codes of the three states (other codes are dropped, not relabelled), horizons in years.
NACC_STATES = {1: 1, 3: 2, 4: 3}
HORIZONS = (2.0, 4.0, 8.0)


def date(col: Column, *formats: str) -> Column:
    """Date by the first format that reads it, null where none does."""
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in (formats or ("yyyy-MM-dd", "MM/dd/yyyy", "yyyy-MM"))]).cast("date")


def years(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) / F.lit(DAYS)


def failed_qc(col: Column, policy: str = "text") -> Column:
    """QC failure by policy: ``text`` takes 1, true and yes, ``number`` a numeric 1 only."""
    text = F.lower(F.trim(F.coalesce(col.cast("string"), F.lit(""))))
    return text.isin("1", "true", "yes") if policy == "text" else F.coalesce(text.try_cast("double") == 1, F.lit(False))


def valid_visits(df: DataFrame, key: str, when: Column, state: Column, qc: Column | None = None, policy: str = "text") -> DataFrame:
    """(key, day, state, *others) of visits with key, date and a state of 1 to 3 that did not fail QC."""
    out = df.withColumn("day", when).withColumn("state", state.try_cast("int")).where(F.col(key).isNotNull() & F.col("day").isNotNull() & F.col("state").isin(1, 2, 3))
    return out.where(~failed_qc(qc, policy)) if qc is not None else out


def recoded(col: Column, states: Mapping[int, int] = NACC_STATES) -> Column:
    out = F.lit(None).cast("int")
    for k, v in states.items():
        out = F.when(col == k, v).otherwise(out)
    return out


def trajectories(visits: DataFrame, key: str, baseline: Column) -> DataFrame:
    """(key, t, state): one visit a day from the baseline on, in elapsed years.

    The baseline flag is taken before days with several states are dropped; a person without a baseline that
    survives is left out.
    """
    marked = visits.withColumn("_base", baseline)
    calm = longitudinal.without_discordant(marked, [key, "day"], "state").groupBy(key, "day").agg(F.min("state").alias("state"), F.max(F.col("_base").cast("int")).alias("_base"))
    start = calm.where("_base = 1").groupBy(key).agg(F.min("day").alias("_day0"))
    return calm.join(start, key).where("day >= _day0").select(key, years(F.col("day"), F.col("_day0")).alias("t"), "state")


def covariates(df: DataFrame, age: str, sex: str, female, education: str, genotype: str) -> DataFrame:
    """age10 (centred at 75, per decade), its square, female, educ4 (centred at 16, per four years), e4 carriage."""
    a = (F.col(age) - 75) / 10
    g = F.split(F.col(genotype).cast("string"), "/")
    e4 = F.when(F.size(g) == 2, F.exists(g, lambda x: F.trim(x) == "4").cast("int"))
    return df.withColumns({"age10": a, "age10_sq": a * a, "female": F.when(F.col(sex).isNotNull(), (F.col(sex) == female).cast("int")), "educ4": (F.col(education) - 16) / 4, "e4": e4})


def outcome(time_to_event: Column, follow_up: Column, horizon: float) -> tuple[Column, Column]:
    """(duration, event): an event if 0 < time <= horizon, else censored at the lesser of follow-up and horizon."""
    event = F.coalesce((time_to_event > 0) & (time_to_event <= horizon), F.lit(False))
    return F.when(event, time_to_event).otherwise(F.least(follow_up, F.lit(float(horizon)))), event.cast("int")


def with_support(df: DataFrame, centre: str, flag: str) -> DataFrame:
    """Rows of centres that have both classes."""
    both = df.groupBy(centre).agg(F.min(flag).alias("lo"), F.max(flag).alias("hi")).where("lo <> hi")
    return df.join(both.select(centre), centre, "left_semi")


def dummies(df: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """0/1 columns of a bounded set of phases; the first in order is the reference."""
    values = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(200).collect())[1:]
    names = [f"{column}_{v}" for v in values]
    return df.withColumns({n: (F.col(column) == v).cast("double") for n, v in zip(names, values, strict=True)}), names


def centre_logistic(df: DataFrame, y: str, xs: Sequence[str], centre: str, frequency: str | None = None, ridge: float = 1e-6, steps: int = 50) -> tuple[np.ndarray, dict]:
    """(coefficients, intercept by centre) of a logistic with an intercept per centre; the ridge holds for all of them.

    Each step sums gradient and curvature by centre; the driver eliminates the intercepts (their block of the
    Hessian is diagonal) and solves for the shared coefficients. What it holds follows the centres, not the rows.
    """
    p = len(xs)
    data = df.select(F.col(centre).alias("c"), F.col(y).cast("double").alias("y"), *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)], (F.col(frequency).cast("double") if frequency else F.lit(1.0)).alias("w")).na.drop().cache()
    try:
        alpha = {r[0]: 0.0 for r in data.select("c").distinct().collect()}
        beta = np.zeros(p)
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        spark = df.sparkSession

        def at(b: np.ndarray, a: dict) -> tuple[float, dict]:
            base = spark.createDataFrame([(k, float(v)) for k, v in a.items()], f"c {data.schema['c'].dataType.simpleString()}, a double")
            eta = sum((F.lit(float(v)) * F.col(f"x{i}") for i, v in enumerate(b)), F.col("a"))
            rows = data.join(F.broadcast(base), "c").withColumn("eta", eta).withColumn("mu", 1 / (1 + F.exp(-F.col("eta"))))
            g, h = F.col("w") * (F.col("y") - F.col("mu")), F.col("w") * F.col("mu") * (1 - F.col("mu"))
            fit = F.col("w") * (F.col("y") * F.col("eta") - F.greatest("eta", F.lit(0.0)) - F.log1p(F.exp(-F.abs("eta"))))
            out = rows.groupBy("c").agg(F.sum(fit).alias("f"), F.sum(g).alias("g"), F.sum(h).alias("h"), *[F.sum(g * F.col(f"x{i}")).alias(f"g{i}") for i in range(p)], *[F.sum(h * F.col(f"x{i}")).alias(f"h{i}") for i in range(p)], *[F.sum(h * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i, j in pairs]).collect()
            parts = {r["c"]: r for r in out}
            return sum(r["f"] for r in out) - ridge / 2 * (float(b @ b) + sum(v * v for v in a.values())), parts

        value, parts = at(beta, alpha)
        for _ in range(steps):
            schur, rhs = ridge * np.eye(p), -ridge * beta
            for c, r in parts.items():
                hc, cross = r["h"] + ridge, np.array([r[f"h{i}"] for i in range(p)])
                full = np.zeros((p, p))
                for i, j in pairs:
                    full[i, j] = full[j, i] = r[f"h{i}_{j}"]
                schur += full - np.outer(cross, cross) / hc
                rhs += np.array([r[f"g{i}"] for i in range(p)]) - cross * (r["g"] - ridge * alpha[c]) / hc
            step = np.linalg.solve(schur, rhs)
            moves = {c: (r["g"] - ridge * alpha[c] - float(np.array([r[f"h{i}"] for i in range(p)]) @ step)) / (r["h"] + ridge) for c, r in parts.items()}
            size = 1.0
            while True:
                b, a = beta + size * step, {c: alpha[c] + size * moves[c] for c in alpha}
                new, found = at(b, a)
                if new >= value - 1e-10 or size < 1e-6:
                    break
                size /= 2
            beta, alpha, value, parts = b, a, new, found
            if max([*np.abs(size * step), *(abs(size * m) for m in moves.values())], default=0.0) < 1e-9:
                break
    finally:
        data.unpersist()
    return beta, alpha


def exposure_analysis(df: DataFrame, selected: str, exposure: str, design: Sequence[str], time: str, event: str, stratum: str, winsor: tuple[float, float] | None = (0.01, 0.99)) -> dict:
    """Selection logistic, stabilised weights, weighted stratified Cox and balance of one exposure."""
    full = df.na.drop(subset=[selected, exposure, *design])
    fit = {r["term"]: r["estimate"] for r in estimators.logistic(full, selected, [exposure, *design]).collect()}
    eta = sum((F.lit(fit[x]) * F.col(x) for x in [exposure, *design]), F.lit(fit["intercept"]))
    scored = full.withColumn("_p", 1 / (1 + F.exp(-eta)))
    lo, hi = winsor if winsor else (None, None)
    weighted = estimators.selection_weights(scored, "_p", selected, lo, hi)
    cox = estimators.cox(weighted, time, event, [exposure], stratum, "weight").first()
    ess = aggregates.effective_size(weighted, "weight").first()
    return {"log_hazard": cox["estimate"], "hazard_ratio": math.exp(cox["estimate"]), "se": cox["se"], "n": ess["n"], "ess": ess["ess"], "selection": fit}


def direct_metrics(visits: DataFrame, key: str, weights: DataFrame | None = None) -> DataFrame:
    """Share of people reaching state 3 who were not seen in state 2 before, by bootstrap repetition when weights (rep, key, boot) are given."""
    first = visits.groupBy(key).agg(F.min(F.when(F.col("state") == 2, F.col("t"))).alias("m"), F.min(F.when(F.col("state") == 3, F.col("t"))).alias("e")).where("e is not null")
    direct = (F.col("m").isNull() | (F.col("m") >= F.col("e"))).cast("int")
    if weights is None:
        return first.agg(F.count("*").alias("n"), F.sum(direct).alias("n_direct")).withColumn("share", F.try_divide("n_direct", "n"))
    return first.join(weights, key).groupBy("rep").agg(F.sum("boot").alias("n"), F.sum(F.col("boot") * direct).alias("n_direct")).withColumn("share", F.try_divide("n_direct", "n"))


def masked(visits: DataFrame, key: str, schedules: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Visits under each schedule (name, period, window) and ``full``, as one frame."""
    out = visits.select(F.lit("full").alias("schedule"), key, "t", "state")
    for name, period, window in schedules:
        out = out.unionByName(longitudinal.mask_visits(visits.select(key, "t", "state"), key, "t", period, window).select(F.lit(name).alias("schedule"), key, "t", "state"))
    return out


def paired_bootstrap(visits: DataFrame, key: str, unit: str, schedules: Sequence[tuple[str, float, float]], reps: int = 200, seed: int = 1) -> DataFrame:
    """(schedule, estimate, low, high, difference_low, difference_high, valid): direct share under each schedule with the same resampled units, and its difference from the full series."""
    frames = masked(visits, key, schedules)
    first = frames.groupBy("schedule", key).agg(F.min(F.when(F.col("state") == 2, F.col("t"))).alias("m"), F.min(F.when(F.col("state") == 3, F.col("t"))).alias("e")).where("e is not null")
    first = first.withColumn("direct", (F.col("m").isNull() | (F.col("m") >= F.col("e"))).cast("int")).join(visits.select(key, unit).distinct(), key) if unit != key else first.withColumn("direct", (F.col("m").isNull() | (F.col("m") >= F.col("e"))).cast("int"))
    w = estimators.multiplicities(visits, unit, reps, seed).withColumnRenamed("m", "weight")
    shares = first.join(w, unit).groupBy("rep", "schedule").agg((F.sum(F.col("weight") * F.col("direct")) / F.sum("weight")).alias("share"))
    full = shares.where("schedule = 'full'").select("rep", F.col("share").alias("full"))
    both = shares.join(full, "rep")
    ends = lambda c, p: F.percentile(c, F.lit(p))
    point = first.groupBy("schedule").agg(F.avg("direct").alias("estimate"))
    diff = F.col("share") - F.col("full")
    return both.groupBy("schedule").agg(ends("share", 0.025).alias("low"), ends("share", 0.975).alias("high"), ends(diff, 0.025).alias("difference_low"), ends(diff, 0.975).alias("difference_high"), F.count("share").alias("valid")).join(point, "schedule")


def schedules(spark: SparkSession, months: Sequence[int], horizon: int = 60) -> DataFrame:
    """(interval, follow_ups, n): months of the visits that an interval gives within a horizon."""
    df = spark.createDataFrame([(int(m),) for m in months], "interval int")
    visits = F.filter(F.sequence(F.col("interval"), F.lit(horizon), F.col("interval")), lambda m: m <= horizon)
    visits = F.when(F.col("interval") <= horizon, visits).otherwise(F.array().cast("array<int>"))
    return df.select("interval", F.array_join(visits, ";").alias("follow_ups"), F.size(visits).alias("n"))


def prevalence_grid(examples: DataFrame, prevalences: Sequence[float]) -> DataFrame:
    """Predictive values of each example (name, sens, spec) at each prevalence."""
    grid = examples.withColumn("prevalence", F.explode(F.array(*map(F.lit, prevalences))))
    return grid.withColumn("x", transport(F.col("sens"), F.col("spec"), F.col("prevalence"))).select("name", "prevalence", "x.*")


def evidence_differences(df: DataFrame, study: str, strict: str, loose: str) -> DataFrame:
    """Within-study drop between a loose and a strict protocol; negative drops are refused."""
    out = df.withColumn("difference", F.round(F.col(loose) - F.col(strict), 2))
    return out.withColumn("difference", F.when(F.assert_true(F.col("difference") >= 0).isNull(), F.col("difference"))).orderBy(study)


def visit_gaps(visits: DataFrame, key: str) -> DataFrame:
    """People, gap quartiles in days, and people whose gaps are all within 400 and 548 days."""
    g = visits.withColumn("gap", (F.col("t") - F.lag("t").over(Window.partitionBy(key).orderBy("t"))) * DAYS).where("gap is not null")
    q = g.agg(F.percentile("gap", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    per = g.groupBy(key).agg(F.max("gap").alias("m")).agg(F.count("*").alias("people"), F.count_if(F.col("m") <= 400).alias("within_400"), F.count_if(F.col("m") <= 548).alias("within_548"))
    return per.crossJoin(q).select("people", "within_400", "within_548", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))


def verify(frame: pd.DataFrame, saved: Mapping[str, float], tolerance: float = 1e-8) -> list[str]:
    """Names whose recomputed value (name, value) is missing or off."""
    found = dict(zip(frame["name"], frame["value"], strict=True))
    return [k for k, v in saved.items() if k not in found or abs(found[k] - v) > tolerance]


def frequency(df: DataFrame, *columns: str) -> DataFrame:
    """(column, value, n): every value's rows, nulls too, of several columns in one pass."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(each).alias("f")).groupBy("f.column", "f.value").agg(F.count("*").alias("n"))


def audit(df: DataFrame, key: str, stages: Mapping[str, Column]) -> DataFrame:
    """(stage, rows, people): rows that pass each stage and all before it, and their people, in one pass."""
    passed, sums = F.lit(True), []
    for name, when in stages.items():
        passed = passed & F.coalesce(when, F.lit(False))
        sums += [F.count_if(passed).alias(f"r_{name}"), F.countDistinct(F.when(passed, F.col(key))).alias(f"p_{name}")]
    return df.agg(*sums).select(F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(f"r_{n}").alias("rows"), F.col(f"p_{n}").alias("people")) for n in stages])).alias("s")).select("s.*")


def covariate_counts(df: DataFrame, age: Column, sex: Column, education: Column, genotype: Column, tobacco: Column) -> DataFrame:
    """People with age, sex and education in range, and those of them with either exposure or both."""
    known = lambda c: F.coalesce(c, F.lit(False))
    common = known(age.between(50, 120) & sex.isin(1, 2) & education.between(0, 36))
    gene, smoke = known(genotype.between(1, 6)), known(tobacco.isin(0, 1))
    return df.agg(F.count("*").alias("people"), F.count_if(common).alias("common"), F.count_if(common & gene).alias("with_genotype"), F.count_if(common & smoke).alias("with_smoking"), F.count_if(common & gene & smoke).alias("with_both"))


def first_after(visits: DataFrame, key: str) -> DataFrame:
    """(key, middle, end, last): first times in states 2 and 3 and the last time, after a baseline (t = 0) in state 1. People whose past or baseline is in another state are left out."""
    start = visits.where("t = 0").groupBy(key).agg(F.min("state").alias("_s0"))
    past = visits.where("t < 0 and state in (2, 3)").select(key).distinct()
    own = visits.join(start.where("_s0 = 1"), key).join(past, key, "left_anti").where("t > 0")
    sums = own.groupBy(key).agg(F.min(F.when(F.col("state") == 2, F.col("t"))).alias("middle"), F.min(F.when(F.col("state") == 3, F.col("t"))).alias("end"), F.max("t").alias("last"))
    return start.where("_s0 = 1").join(past, key, "left_anti").select(key).join(sums, key, "left")


def incident_summary(visits: DataFrame, key: str, years_: float = 4.0) -> DataFrame:
    """Baseline people, those seen in the middle state before any end, and what follows it."""
    f = first_after(visits, key)
    incident = F.col("middle").isNotNull() & (F.col("end").isNull() | (F.col("middle") < F.col("end")))
    after, event = F.col("last") - F.col("middle"), F.col("end") - F.col("middle")
    return f.agg(
        F.count("*").alias("baseline"), F.count_if(incident).alias("incident"), F.count_if(incident & F.coalesce(event > 0, F.lit(False))).alias("later_end"), F.count_if(incident & F.coalesce((event > 0) & (event <= years_), F.lit(False))).alias("end_within"),
        F.count_if(incident & (after > 0)).alias("followed"), F.count_if(incident & (after <= 0)).alias("not_followed"), F.percentile(F.when(incident & (after > 0), after), F.lit(0.5)).alias("median_follow_up"),
    )


def between_events(visits: DataFrame, key: str, code: int, within: float = 8.0) -> DataFrame:
    """(converters, direct, direct_with_code): people who reach the end within a time, those not seen in the middle before, and those of them with a visit of ``code`` (raw column) strictly between baseline and end."""
    f = first_after(visits, key).where(F.col("end") <= within).withColumn("direct", F.col("middle").isNull() | (F.col("middle") > F.col("end")))
    seen = visits.where((F.col("raw") == code) & (F.col("t") > 0)).select(key, "t").join(f.select(key, "end"), key).where("t < end").select(key, F.lit(True).alias("seen")).distinct()
    return f.join(seen, key, "left").agg(F.count("*").alias("converters"), F.count_if("direct").alias("direct"), F.count_if(F.col("direct") & F.coalesce("seen", F.lit(False))).alias("direct_with_code"))


def endpoint_subset(visits: DataFrame, key: str, target: float = 4.0, window: float = 0.5) -> DataFrame:
    """Visits up to the one nearest to ``target`` within the window (ties: the earlier) of people who have one; ``endpoint`` is its time."""
    near = F.struct(F.abs(F.col("t") - target), F.col("t"))
    ends = visits.where(F.abs(F.col("t") - target) <= window).groupBy(key).agg(F.min_by("t", near).alias("endpoint"))
    return visits.join(ends, key).where(F.col("t") <= F.col("endpoint"))


def grid_sensitivity(visits: DataFrame, key: str, periods: Sequence[float], windows: Sequence[float], literal: bool = False) -> DataFrame:
    """(period, offset, window, n, n_direct, share): the direct share under every schedule of period, offset (none and half) and window.

    With ``literal`` the first visits alone are kept besides the grid, not the last.
    """
    out = None
    for period in periods:
        for offset in (0.0, period / 2):
            for window in windows:
                kept = longitudinal.mask_visits(visits.select(key, "t", "state"), key, "t", period, window, offset, terminal=not literal)
                row = direct_metrics(kept, key).select(F.lit(float(period)).alias("period"), F.lit(float(offset)).alias("offset"), F.lit(float(window)).alias("window"), "n", "n_direct", "share")
                out = row if out is None else out.unionByName(row)
    return out


def left_merge(base: DataFrame, key: str, parts: Sequence[DataFrame]) -> DataFrame:
    """``base`` with the columns of each part by key; a part that holds a key twice is refused, so that no row of ``base`` is doubled."""
    out = base
    for part in parts:
        if not part.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"a merged table holds a {key} twice")
        out = out.join(part, key, "left")
    return out
