"""Counts, shares, cells, thresholds and balance tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coded import percent


def crosstab(df: DataFrame, row: Column, col: str, values: Sequence[str], name: str) -> DataFrame:
    """Counts by row and value, and each count's percentage of its row. One shuffle: the values are known."""
    wide = df.groupBy(row.alias(name)).agg(*[F.count_if(F.col(col) == v).alias(f"n_{v.lower()}") for v in values])
    total = sum((F.col(f"n_{v.lower()}") for v in values[1:]), F.col(f"n_{values[0].lower()}"))
    return wide.select("*", *[percent(F.col(f"n_{v.lower()}"), total).alias(f"pct_{v.lower()}") for v in values])


def conditional_share(df: DataFrame, keys: Sequence[str], when: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(when).alias("n_true")).withColumn("pct", percent(F.col("n_true"), F.col("n")))


def quartiles(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Inclusive quartiles by linear interpolation."""
    q = df.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select(*keys, "n", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))


def cells(df: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str, few: int = 1) -> DataFrame:
    """Count of every cell of two small dimensions, empty ones too, flagged at ``few`` or less."""
    counts = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return left.crossJoin(right).join(counts, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n")).withColumn("sparse", F.col("n") <= few)


def coded_matrix(df: DataFrame, codes: Column, row: str) -> DataFrame:
    """Counts by code and row value where a record counts once under each of its codes; margins count records once."""
    per = df.select(F.explode(F.array_distinct(codes)).alias("code"), F.col(row).alias("value")).groupBy("code", "value").agg(F.count("*").alias("n"))
    total = df.groupBy(F.col(row).alias("value")).agg(F.count("*").alias("n")).select(F.lit("all").alias("code"), "value", "n")
    return per.unionByName(total)


def monopolies(df: DataFrame, group: str, value: str, least: int = 3) -> DataFrame:
    """Groups of ``least`` rows or more that know one value only."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.min(value).alias("only"), F.max(value).alias("_m")).where((F.col("n") >= least) & (F.col("only") == F.col("_m"))).drop("_m")


def threshold_table(df: DataFrame, value: str, cuts: Sequence[float], flag: Column) -> DataFrame:
    """Rows at or above each cut, and those of them with the flag, in one pass."""
    sums = df.agg(*[F.count_if(F.col(value) >= c).alias(f"n{i}") for i, c in enumerate(cuts)], *[F.count_if((F.col(value) >= c) & flag).alias(f"f{i}") for i, c in enumerate(cuts)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.col(f"n{i}").alias("n"), F.col(f"f{i}").alias("n_flag")) for i, c in enumerate(cuts)])).alias("r")).select("r.*")


def surviving_groups(df: DataFrame, group: str, keep: Column, least: int = 3) -> DataFrame:
    """Groups with their members and those that stay; they survive with ``least`` or more."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(keep).alias("n_keep")).withColumn("survives", F.col("n_keep") >= least)


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two binary readers: cells, accuracy and Cohen's kappa (null where expected agreement is 1)."""
    n = df.agg(*[F.count_if((F.col(a) == i) & (F.col(b) == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)])
    total = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    po = F.try_divide(F.col("n00") + F.col("n11"), total)
    pe = F.try_divide((F.col("n00") + F.col("n01")) * (F.col("n00") + F.col("n10")) + (F.col("n10") + F.col("n11")) * (F.col("n01") + F.col("n11")), total * total)
    return n.select("*", po.alias("accuracy"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def weighted_smd(df: DataFrame, value: str, weight: Column, treated: Column) -> DataFrame:
    """Standardised mean difference by weights; the scale is the mean of the two population variances."""
    parts = []
    for k, own in (("t", treated), ("c", ~treated)):
        w, x = F.when(own, weight), F.when(own, F.col(value))
        parts += [F.sum(w).alias(f"w_{k}"), F.sum(w * x).alias(f"s_{k}"), F.var_pop(x).alias(f"v_{k}")]
    r = df.agg(*parts)
    mean_t, mean_c = F.col("s_t") / F.col("w_t"), F.col("s_c") / F.col("w_c")
    return r.select(mean_t.alias("mean_t"), mean_c.alias("mean_c"), F.try_divide(mean_t - mean_c, F.sqrt((F.col("v_t") + F.col("v_c")) / 2)).alias("smd"))


def effective_size(df: DataFrame, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    w = F.col(weight)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"))


def anchor_terms(docs: DataFrame, tokens: Column, doc: str, share: float = 0.03, least: int = 3, length: int = 7) -> DataFrame:
    """Terms in few documents (at most max(least, floor(share n))) that are long or hyphenated, with their frequency.

    Words are counted after they are made distinct in each document, so the shuffle carries partial counts.
    """
    n = docs.agg(F.count("*").alias("n_docs"))
    df = docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    limit = F.greatest(F.lit(least), F.floor(share * F.col("n_docs")))
    return df.crossJoin(F.broadcast(n)).where((F.col("df") <= limit) & ((F.length("term") >= length) | F.col("term").contains("-"))).select("term", "df")


def sensitivity_grid(df: DataFrame, gap: str, rules: dict[str, Column], policies: dict[str, Column]) -> DataFrame:
    """Rows whose gap reaches each rule's threshold under each policy's filter."""
    grid = [F.struct(F.lit(r).alias("rule"), F.lit(p).alias("policy"), F.coalesce((F.col(gap) + 1e-12 >= t) & keep, F.lit(False)).alias("hit")) for r, t in rules.items() for p, keep in policies.items()]
    return df.select(F.explode(F.array(*grid)).alias("g")).groupBy("g.rule", "g.policy").agg(F.count_if("g.hit").alias("n"))


def threshold_ids(df: DataFrame, value: str, cuts: Sequence[float], external: Column, key: str, order: Column) -> DataFrame:
    """(cut, n, internal, external, ids): rows at or above each cut and, in order, the keys of the external ones. Only those keys, of the highest cut each reaches, are gathered."""
    d = df.select(F.col(key).alias("key"), order.alias("o"), F.col(value).alias("v"), F.coalesce(external, F.lit(False)).alias("x")).withColumn("cut", F.explode(F.array(*[F.lit(float(c)) for c in cuts]))).where(F.col("v") >= F.col("cut"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("x"), F.struct("o", "key")))), lambda r: r["key"]), ", ")
    return d.groupBy("cut").agg(F.count("*").alias("n"), F.count_if(~F.col("x")).alias("internal"), F.count_if("x").alias("external"), ids.alias("ids"))


def adjudicated(sheet: DataFrame, key: DataFrame, left_out: DataFrame) -> DataFrame:
    """(policy, kind, n, agree, tp, fn, tn, fp): verdicts of a worksheet (item, verdict, note) against its key (item, first_reader, kind).

    Empty verdicts, excluded items and those marked as not blind take no part. ``rescope`` counts as admit under one
    policy and as reject under the other; kind ``all`` is the sum.
    """
    v = F.lower(F.trim(F.coalesce("verdict", F.lit(""))))
    own = sheet.withColumn("v", v).where((F.col("v") != "") & ~F.upper(F.coalesce("note", F.lit(""))).contains("[NONBLIND")).join(left_out.select("item"), "item", "left_anti").join(key, "item")
    each = own.withColumn("policy", F.explode(F.array(F.lit("admit"), F.lit("reject")))).withColumn("second", F.when(F.col("v") == "rescope", F.col("policy")).otherwise(F.col("v"))).withColumn("kind", F.explode(F.array("kind", F.lit("all"))))
    one, two = F.col("first_reader") == "admit", F.col("second") == "admit"
    return each.groupBy("policy", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("first_reader") == F.col("second")).alias("agree"), F.count_if(one & two).alias("tp"), F.count_if(~one & two).alias("fn"), F.count_if(~one & ~two).alias("tn"), F.count_if(one & ~two).alias("fp"))
