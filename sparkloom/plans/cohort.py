"""Longitudinal queries: events of users stand for visits of people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import longitudinal as lon
from .reports import _t


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with hours since the table's first instant."""
    return _t(spark, sf_dir, "events").withColumn("h", F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9)


def q_anti_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return lon.without_discordant(e, ["user_id", "day"], "event_type").select("event_id", "user_id", "day", "event_type")


def q_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every error the user's last purchase value and last view value at or before it."""
    e = _t(spark, sf_dir, "events")
    known = e.withColumns({"purchase": F.when(F.col("event_type") == "purchase", F.col("value")), "viewed": F.when(F.col("event_type") == "view", F.col("value"))}).where("event_type in ('purchase', 'view')")
    errors = e.where("event_type = 'error'").select("user_id", "event_id", F.col("ts").alias("at"))
    return lon.as_of(errors, known, "user_id", "at", "ts", ["purchase", "viewed"]).select("event_id", "user_id", "purchase", "viewed")


def q_interval_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other events of the user within six hours before each error."""
    e = _t(spark, sf_dir, "events")
    errors = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("at"))
    other = e.where("event_type <> 'error'").select("user_id", "event_id", "ts")
    return lon.within_before(errors, other, "user_id", "at", "ts", 21_600).groupBy("error_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def q_grid_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = lon.nearest_to_grid(_visits(spark, sf_dir).select("user_id", "event_id", "h"), "user_id", "h", 24.0, 6.0, "event_id")
    return near.select("user_id", "target", "event_id")


def q_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = lon.transitions(_visits(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type", "h", "error")
    return steps.groupBy("s0", "s1").agg(F.count("*").alias("n"), F.round(F.sum("dt"), 4).alias("hours"))


def q_cif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competing incidence of the first purchase or error after a user's first view, in whole days."""
    v = _visits(spark, sf_dir).where("event_type in ('view', 'purchase', 'error')").withColumn("d", F.floor(F.col("h") / 24))
    start = v.where("event_type = 'view'").groupBy("user_id").agg(F.min("d").alias("d0"))
    later = v.join(start, "user_id").where("d >= d0")
    rec = later.groupBy("user_id").agg(F.max("d").alias("last"), F.min("d0").alias("d0"), F.min(F.when(F.col("event_type") != "view", F.struct("d", "event_type"))).alias("e"))
    rec = rec.select((F.coalesce("e.d", "last") - F.col("d0")).alias("time"), F.col("e.event_type").alias("event"))
    return lon.cumulative_incidence(rec).select("t", "event", F.round("cif", 9).alias("cif"))


def q_gap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _visits(spark, sf_dir).withColumn("gap", F.col("h") - F.lag("h").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("gap is not null")
    q = v.agg(F.count("*").alias("n"), F.percentile("gap", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    close = v.groupBy("user_id").agg(F.max("gap").alias("m")).agg(F.count_if(F.col("m") <= 48).alias("n_close"))
    return q.crossJoin(close).select("n", "n_close", *[F.round(F.col("q")[i], 6).alias(x) for i, x in enumerate(("q25", "median", "q75"))])


def q_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_any"), F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("first_f"), F.max("o_orderdate").alias("last_any"))


def q_direct_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lon.direct_share(_visits(spark, sf_dir), "user_id", "h", "event_type", "purchase", "error")


def q_mask_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits that a weekly schedule with a day's window keeps, by elapsed days; one visit per user and hour."""
    v = _visits(spark, sf_dir).groupBy("user_id", F.floor("h").alias("h")).agg(F.min("event_id").alias("event_id"))
    v = v.withColumn("days", (F.col("h") - F.min("h").over(Window.partitionBy("user_id"))) / 24.0)
    return lon.mask_visits(v, "user_id", "days", 7.0, 1.0).select("user_id", "event_id", F.round("days", 6).alias("days"))


def q_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statuses of a customer as states: compressed panel of whole-day intervals."""
    o = _t(spark, sf_dir, "orders").withColumn("d", F.datediff("o_orderdate", F.lit("1995-01-01")))
    return lon.panel(lon.transitions(o, "o_custkey", ["d", "o_orderkey"], "o_orderstatus", "d", "P")).select(F.col("dt").cast("bigint").alias("dt"), "s0", "s1", "n")


def q_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lon.first_rows(_t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


def q_risk_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted risk-set sums by stratum at each time, ties together (time from the latest down)."""
    l = _t(spark, sf_dir, "lineitem").select("l_returnflag", F.to_date("l_shipdate").alias("d"), "l_quantity")  # noqa: E741
    by = l.groupBy("l_returnflag", "d").agg(F.sum("l_quantity").alias("w"), F.count("*").alias("n"))
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("d")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return by.select("l_returnflag", "d", "n", F.round(F.sum("w").over(w), 4).alias("risk"))


QUERIES = {f.__name__: f for f in (q_anti_conflict, q_asof, q_interval_window, q_grid_nearest, q_transitions, q_cif, q_gap_stats, q_first_last, q_direct_share, q_mask_visits, q_panel, q_baseline, q_risk_sums)}

_H = "epoch_us(ts) / 3.6e9"
SQL = {
    "q_anti_conflict": "SELECT event_id, user_id, ts::DATE AS day, event_type FROM events e WHERE (SELECT count(DISTINCT event_type) FROM events x WHERE x.user_id = e.user_id AND x.ts::DATE = e.ts::DATE) = 1",
    "q_asof": """
SELECT e.event_id, e.user_id, arg_max(p.value, p.ts) FILTER (p.event_type = 'purchase') AS purchase, arg_max(p.value, p.ts) FILTER (p.event_type = 'view') AS viewed
FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.ts <= e.ts AND p.event_type IN ('purchase', 'view') WHERE e.event_type = 'error' GROUP BY 1, 2""",
    "q_interval_window": """
SELECT e.event_id AS error_id, count(*) AS n, max(p.event_id) AS last_id FROM events e JOIN events p ON p.user_id = e.user_id AND p.ts <= e.ts AND p.ts >= e.ts - INTERVAL 6 HOUR AND p.event_type <> 'error' WHERE e.event_type = 'error' GROUP BY 1""",
    "q_grid_nearest": f"""
WITH v AS (SELECT user_id, event_id, {_H} AS h FROM events), g AS (SELECT *, unnest(range(ceil((h - 6.0) / 24.0)::BIGINT, floor((h + 6.0) / 24.0)::BIGINT + 1)) AS target FROM v)
SELECT user_id, target, event_id FROM g QUALIFY row_number() OVER (PARTITION BY user_id, target ORDER BY abs(h - target * 24.0), h, event_id) = 1""",
    "q_transitions": f"""
WITH v AS (SELECT user_id, event_type AS s0, {_H} AS h, lead(event_type) OVER w AS s1, lead({_H}) OVER w AS h1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS (SELECT user_id, min({_H}) FILTER (event_type = 'error') AS stop FROM events GROUP BY 1)
SELECT s0, s1, count(*) AS n, round(sum(h1 - h), 4) AS hours FROM v JOIN x USING (user_id) WHERE s1 IS NOT NULL AND (stop IS NULL OR h < stop) GROUP BY 1, 2""",
    "q_cif": f"""
WITH v AS (SELECT user_id, event_type, floor({_H} / 24)::BIGINT AS d FROM events WHERE event_type IN ('view', 'purchase', 'error')),
s AS (SELECT user_id, min(d) AS d0 FROM v WHERE event_type = 'view' GROUP BY 1),
r AS (SELECT user_id, min(d0) AS d0, max(d) AS last, min(struct_pack(d := d, e := event_type)) FILTER (event_type <> 'view') AS e FROM v JOIN s USING (user_id) WHERE d >= d0 GROUP BY 1),
rec AS (SELECT coalesce(e.d, last) - d0 AS t, e.e AS event FROM r),
b AS (SELECT t, count(*)::DOUBLE AS n, count(event)::DOUBLE AS d FROM rec GROUP BY 1),
k AS (SELECT t, d, (SELECT sum(n) FROM b y WHERE y.t >= b.t) AS risk FROM b),
f AS (SELECT t, risk, coalesce((SELECT product(1 - y.d / y.risk) FROM k y WHERE y.t < k.t), 1.0) AS free FROM k),
st AS (SELECT rec.t, rec.event, any_value(free) * count(*) / any_value(risk) AS step FROM rec JOIN f ON rec.t = f.t WHERE event IS NOT NULL GROUP BY 1, 2)
SELECT t, event, round(sum(step) OVER (PARTITION BY event ORDER BY t), 9) AS cif FROM st""",
    "q_gap_stats": f"""
WITH g AS (SELECT user_id, {_H} - lag({_H}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT count(gap) AS n, (SELECT count(*) FROM (SELECT user_id FROM g GROUP BY 1 HAVING max(gap) <= 48)) AS n_close, round(quantile_cont(gap, 0.25), 6) AS q25, round(quantile_cont(gap, 0.5), 6) AS median, round(quantile_cont(gap, 0.75), 6) AS q75 FROM g WHERE gap IS NOT NULL""",
    "q_first_last": "SELECT o_custkey, min(o_orderdate) AS first_any, min(o_orderdate) FILTER (o_orderstatus = 'F') AS first_f, max(o_orderdate) AS last_any FROM orders GROUP BY 1",
    "q_direct_share": """
WITH f AS (SELECT user_id, min(ts) FILTER (event_type = 'purchase') AS m, min(ts) FILTER (event_type = 'error') AS e FROM events GROUP BY 1)
SELECT count(e) AS n_end, count(*) FILTER (e IS NOT NULL AND (m IS NULL OR m >= e)) AS n_direct, count(*) FILTER (e IS NOT NULL AND (m IS NULL OR m >= e))::DOUBLE / count(e) AS share FROM f""",
    "q_mask_visits": f"""
WITH v AS (SELECT user_id, floor({_H})::BIGINT AS h, min(event_id) AS event_id FROM events GROUP BY 1, 2), d AS (SELECT *, (h - min(h) OVER (PARTITION BY user_id)) / 24.0::DOUBLE AS days FROM v),
l AS (SELECT *, max(days) OVER (PARTITION BY user_id) AS last FROM d),
g AS (SELECT *, unnest(range(1, 200)) * 7.0 AS target FROM l),
n AS (SELECT * FROM g WHERE days > 0 AND target <= last + 1.0 + 1e-8 AND abs(days - target) <= 1.0 QUALIFY row_number() OVER (PARTITION BY user_id, target ORDER BY abs(days - target), days) = 1)
SELECT user_id, event_id, round(days, 6) AS days FROM n UNION SELECT user_id, event_id, round(days, 6) FROM l WHERE days = 0 OR days = last""",
    "q_panel": """
WITH v AS (SELECT o_custkey, o_orderkey, o_orderstatus AS s0, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS d FROM orders),
w AS (SELECT *, lead(s0) OVER x AS s1, lead(d) OVER x AS d1, min(d) FILTER (s0 = 'P') OVER (PARTITION BY o_custkey) AS stop FROM v WINDOW x AS (PARTITION BY o_custkey ORDER BY d, o_orderkey))
SELECT (d1 - d)::BIGINT AS dt, s0, s1, count(*) AS n FROM w WHERE s1 IS NOT NULL AND (stop IS NULL OR d < stop) GROUP BY 1, 2, 3""",
    "q_baseline": "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
    "q_risk_sums": """
WITH b AS (SELECT l_returnflag, l_shipdate::DATE AS d, sum(l_quantity) AS w, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, d, n, round(sum(w) OVER (PARTITION BY l_returnflag ORDER BY d DESC), 4) AS risk FROM b""",
}
