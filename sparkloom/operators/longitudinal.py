"""Event-time operators over irregular visits: baselines, as-of and interval lookups, grids, panels, incidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def without_discordant(df: DataFrame, keys: Sequence[str], state: str) -> DataFrame:
    """Rows but those whose keys hold several states."""
    bad = df.groupBy(*keys).agg(F.min(state).alias("lo"), F.max(state).alias("hi")).where("lo <> hi")
    return df.join(bad, list(keys), "left_anti")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, time: str, values: Sequence[str]) -> DataFrame:
    """Left rows with each value's last known one at or before ``at``, field by field.

    Both sides are merged into one stream by key and time and filled forward in one window, so the cost is a sort,
    not the product of visits.
    """
    names = [c for c in left.columns if c != key]
    l = left.select(key, F.col(at).alias("_t"), F.lit(1).alias("_left"), *names, *[F.lit(None).cast(right.schema[v].dataType).alias(f"_v_{v}") for v in values])  # noqa: E741
    r = right.select(key, F.col(time).alias("_t"), F.lit(0).alias("_left"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names], *[F.col(v).alias(f"_v_{v}") for v in values])
    w = Window.partitionBy(key).orderBy("_t", "_left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r)
    for v in values:
        both = both.withColumn(v, F.last(f"_v_{v}", ignorenulls=True).over(w))
    return both.where("_left = 1").select(key, *names, *values)


def within_before(anchors: DataFrame, events: DataFrame, key: str, at: str, time: str, seconds: int) -> DataFrame:
    """Pairs of an anchor and an event of the same key 0 to ``seconds`` before it; times are bucketed so that only neighbours meet."""
    stamp = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = seconds * 1_000_000
    a = anchors.withColumn("_a", stamp(at)).withColumn("_b", F.explode(F.array(F.floor(F.col("_a") / span), F.floor(F.col("_a") / span) - 1)))
    e = events.withColumn("_e", stamp(time)).withColumn("_b", F.floor(F.col("_e") / span))
    return a.join(e, [key, "_b"]).where((F.col("_a") - F.col("_e")).between(0, span)).drop("_a", "_e", "_b")


def nearest_to_grid(visits: DataFrame, key: str, t: str, period: float, window: float, id_col: str) -> DataFrame:
    """For each key and multiple of the period the nearest visit within the window (ties: the earlier). Each visit knows its only possible targets."""
    k0 = F.ceil((F.col(t) - window) / period)
    k1 = F.floor((F.col(t) + window) / period)
    own = visits.where(k0 <= k1).withColumn("target", F.explode(F.sequence(k0, k1)))
    return first_rows(own.withColumn("distance", F.abs(F.col(t) - F.col("target") * period)), [key, "target"], ["distance", t, id_col])


def mask_visits(visits: DataFrame, key: str, t: str, period: float, window: float, offset: float = 0.0, terminal: bool = True) -> DataFrame:
    """Visits that a schedule keeps: the first, the nearest to each target within the window, and the last if asked."""
    w = Window.partitionBy(key)
    v = visits.withColumn("_first", F.min(t).over(w)).withColumn("_last", F.max(t).over(w))
    start = offset if offset else period
    k0 = F.greatest(F.ceil((F.col(t) - window - start) / period), F.lit(0))
    k1 = F.least(F.floor((F.col(t) + window - start) / period), F.floor((F.col("_last") + window + 1e-8 - start) / period))
    later = v.where((F.col(t) > F.col("_first")) & (k0 <= k1)).withColumn("_g", F.explode(F.sequence(k0, k1)))
    near = first_rows(later.withColumn("_d", F.abs(F.col(t) - (start + F.col("_g") * period))), [key, "_g"], ["_d", t]).select(*visits.columns)
    ends = v.where((F.col(t) == F.col("_first")) | (F.lit(terminal) & (F.col(t) == F.col("_last")))).select(*visits.columns)
    return near.unionByName(ends).distinct()


def transitions(visits: DataFrame, key: str, order: Sequence[str], state: str, t: str, absorbing) -> DataFrame:
    """(dt, s0, s1) between consecutive visits up to the first absorbing state."""
    w = Window.partitionBy(key).orderBy(*order)
    v = visits.withColumn("_stop", F.min(F.when(F.col(state) == absorbing, F.col(t))).over(Window.partitionBy(key)))
    v = v.withColumn("s1", F.lead(state).over(w)).withColumn("t1", F.lead(t).over(w))
    return v.where(F.col("s1").isNotNull() & (F.col("_stop").isNull() | (F.col(t) < F.col("_stop")))).select(key, F.col(state).alias("s0"), "s1", (F.col("t1") - F.col(t)).alias("dt"))


def panel(intervals: DataFrame, weight: str | None = None) -> DataFrame:
    """Distinct (dt, s0, s1) with counts: what a Markov fit needs of any number of people."""
    return intervals.groupBy(F.round("dt", 12).alias("dt"), "s0", "s1").agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def first_events(visits: DataFrame, key: str, t: str, state: str, origin) -> DataFrame:
    """(key, time, event): the first state other than the origin after the start, or censoring (event null) at the last visit."""
    away = F.when(F.col(state) != origin, F.struct(t, state))
    v = visits.groupBy(key).agg(F.min(t).alias("_t0"), F.max(t).alias("_last"), F.min(away).alias("e"))
    return v.select(key, (F.coalesce(F.col(f"e.{t}"), F.col("_last")) - F.col("_t0")).alias("time"), F.col(f"e.{state}").alias("event"))


def cumulative_incidence(records: DataFrame, time: str = "time", event: str = "event", weight: str | None = None) -> DataFrame:
    """(time, event, cif) by product-limit over observed times with competing events.

    One row per distinct time enters the windows, however many people there are.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    by_time = records.groupBy(F.col(time).alias("t")).agg(F.sum(w).alias("n"), F.sum(F.when(F.col(event).isNotNull(), w).otherwise(0.0)).alias("d"))
    order = Window.orderBy("t")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy())
    risk = by_time.withColumn("risk", total - F.coalesce(F.sum("n").over(before), F.lit(0.0)))
    risk = risk.withColumn("free", F.coalesce(F.product(1 - F.col("d") / F.col("risk")).over(before), F.lit(1.0)))
    kinds = records.where(F.col(event).isNotNull()).groupBy(F.col(time).alias("t"), F.col(event).alias("event")).agg(F.sum(w).alias("k"))
    steps = kinds.join(risk, "t").withColumn("step", F.col("free") * F.col("k") / F.col("risk"))
    return steps.withColumn("cif", F.sum("step").over(Window.partitionBy("event").orderBy("t"))).select("t", "event", "cif")


def at_horizons(cif: DataFrame, horizons: Sequence[float]) -> DataFrame:
    """The curve's last step at or before each horizon, 0 before the first."""
    return cif.groupBy("event").agg(F.max("cif").alias("_"), *[F.coalesce(F.max_by(F.when(F.col("t") <= h, F.col("cif")), F.when(F.col("t") <= h, F.col("t"))), F.lit(0.0)).alias(f"h{h:g}") for h in horizons]).drop("_")


def direct_share(visits: DataFrame, key: str, t: str, state: str, middle, end) -> DataFrame:
    """People who reach ``end``, and those of them who were not seen in ``middle`` before."""
    first = visits.groupBy(key).agg(F.min(F.when(F.col(state) == middle, F.col(t))).alias("m"), F.min(F.when(F.col(state) == end, F.col(t))).alias("e"))
    return first.agg(F.count("e").alias("n_end"), F.count_if(F.col("e").isNotNull() & (F.col("m").isNull() | (F.col("m") >= F.col("e")))).alias("n_direct")).withColumn("share", F.try_divide("n_direct", "n_end"))


def state_order(visits: DataFrame, key: str, t: str, state: str, a, b) -> DataFrame:
    """(key, order): whether a person was seen in ``a`` before ``b``, in ``b`` before ``a``, in one of them or in neither."""
    first = visits.groupBy(key).agg(F.min(F.when(F.col(state) == a, F.col(t))).alias("_a"), F.min(F.when(F.col(state) == b, F.col(t))).alias("_b"))
    x, y = F.col("_a"), F.col("_b")
    order = F.when(x.isNull() & y.isNull(), "neither").when(y.isNull(), "a only").when(x.isNull(), "b only").when(x < y, "a first").when(y < x, "b first").otherwise("same time")
    return first.select(key, order.alias("order"))
