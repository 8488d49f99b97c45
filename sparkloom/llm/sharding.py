"""Operator 4: sharding by vector bin packing over bytes, tokens and rows.

Rows of equal text form a group and stay together, unless the group alone is larger than ``HOT``
of a shard in some dimension. Groups above 1 / ``PARTS`` of a shard are dealt by doc_id into chunks
of about that size, so that no task ranks a whole large group; the chunks of a group that is not
hot are placed as one parcel, those of a hot group each on its own. Of all other groups those that
fall into one of PARTS cells per shard (by hash of the text) are placed as one parcel. So the
driver holds at most PARTS cells per shard and, as each large group holds a set part of a total,
no more than 3 x PARTS x shards large groups and their chunks: a number that does not grow with
the rows. The largest parcel
goes first, each to the shard where the dot product of its shares with the shard's residual
capacity is highest. The law is ``bytes``: shards are near equal in bytes.

Slots count a shard's rows without gaps: the parcels' row counts give each parcel its first slot,
and rows are ranked within their parcel, in parts by hash of doc_id and text where a parcel holds more
than ``RANKED_BYTES``, whose counts give each part its first slot.

Defined cases: a null text has 8 bytes, no tokens and no checksum, and all null texts are one group;
repeated rows are rows of their own; an empty table gives no rows; other columns are not
looked at. The same input gives the same shards and slots.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, saved, table

SHARDS, PARTS, ROW_BYTES = 24, 64, 8
#: Bytes of text that one task ranks; larger parcels are ranked in parts.
RANKED_BYTES = 256_000_000
#: Groups of equal text up to this part of a shard stay whole; with larger parcels a shard could no longer be filled evenly.
HOT = 0.5
DIMS = ("size", "tokens", "rows")


def pack(loads: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each parcel. ``loads``: parcels x dimensions.

    Largest parcel (by its largest share) first; to the shard with the highest dot product of the
    parcel's shares with the residual capacity; ties go to the lowest shard.
    """
    share = loads / np.maximum(loads.sum(axis=0) / shards, 1e-9)
    left, out = np.ones((shards, loads.shape[1])), np.zeros(len(loads), dtype=np.int64)
    for k in np.argsort(-share.max(axis=1), kind="stable"):
        out[k] = int(np.argmax(left @ share[k]))
        left[out[k]] -= share[k]
    return out


def place(parcels: Sequence[tuple[int | None, int]], loads: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each (group, part); all parts of a group of at most ``HOT`` of a shard go to the same one."""
    groups: dict[int | None, np.ndarray] = {}
    for (group, _), load in zip(parcels, loads, strict=True):
        groups[group] = groups.get(group, 0) + load
    most = HOT * loads.sum(axis=0) / shards
    whole = {g for g, load in groups.items() if g is not None and (load <= most).all()}
    units: dict[tuple, int] = {}
    unit = np.array([units.setdefault((g, None if g in whole else part), len(units)) for g, part in parcels], dtype=np.int64)
    sums = np.zeros((len(units), loads.shape[1]))
    np.add.at(sums, unit, loads)
    return pack(sums, shards)[unit]


def shard(docs: DataFrame, shards: int = SHARDS, parts: int = PARTS, keep: Sequence[str] = ("doc_id",), tokens: Column | None = None) -> DataFrame:
    """Every row with size, text_crc32, shard and slot. ``keep`` names the columns to carry along."""
    spark = docs.sparkSession
    text = F.col("text")
    tokens = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)) if tokens is None else tokens
    slim = docs.select(
        *[F.col(c).alias(f"k_{c}") for c in keep], F.col("doc_id").alias("s_id"), F.xxhash64(text, F.length(text)).alias("group"), F.crc32(text.cast("binary")).alias("crc"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), tokens.cast("long").alias("tokens"), F.lit(1).cast("long").alias("rows"),
    )
    slim = saved(slim, "shard-rows")
    total = slim.agg(*[F.sum(d).alias(d) for d in DIMS]).first()
    if not total["rows"]:
        total = dict.fromkeys(DIMS, 1)
    limit = {d: max(total[d] / shards / parts, 1) for d in DIMS}
    groups = slim.groupBy("group").agg(*[F.sum(d).alias(d) for d in DIMS])
    most = F.greatest(*[F.col(d) / F.lit(float(limit[d])) for d in DIMS])
    large = groups.where((most > 1) & (F.col("rows") > 1)).select("group", F.ceil(most).cast("int").alias("chunks"))  # at most len(DIMS) * shards * parts rows
    cells = shards * parts
    placed = slim.join(F.broadcast(large), "group", "left").withColumn("part", F.when(F.col("chunks").isNull(), F.pmod("group", F.lit(cells))).otherwise(F.pmod(F.xxhash64("s_id", "group"), F.col("chunks"))).cast("int"))
    placed = placed.withColumn("parcel", F.when(F.col("chunks").isNull(), F.struct(F.lit(None).cast("bigint").alias("group"), "part")).otherwise(F.struct("group", "part")))
    loads = placed.groupBy("parcel").agg(*[F.sum(d).alias(d) for d in DIMS]).orderBy("parcel").collect()
    to = place([(r["parcel"]["group"], r["parcel"]["part"]) for r in loads], np.array([[r[d] for d in DIMS] for r in loads], dtype=float).reshape(-1, len(DIMS)), shards)
    first, plan = [0] * shards, []
    for r, s in zip(loads, map(int, to), strict=True):
        plan.append((r["parcel"]["group"], r["parcel"]["part"], s, first[s]))
        first[s] += r["rows"]
    plan = spark.createDataFrame(plan, "p_group bigint, p_part int, shard int, first bigint")
    subs = max(1, int(-(-total["size"] // (cells * RANKED_BYTES))))
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("s_id", "group", F.lit("sub")), F.lit(subs)))
    rank = F.row_number().over(Window.partitionBy("parcel", "sub").orderBy("s_id", "group", *[f"k_{c}" for c in keep if c not in ("doc_id", "text")]))
    rows = placed.withColumn("rank", rank).join(F.broadcast(plan), F.col("parcel.group").eqNullSafe(F.col("p_group")) & (F.col("parcel.part") == F.col("p_part")))
    if subs > 1:
        counts = placed.groupBy("parcel", "sub").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("parcel").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1))
        counts = saved(counts.select(F.col("parcel.group").alias("c_group"), F.col("parcel.part").alias("c_part"), F.col("sub").alias("c_sub"), F.coalesce(before, F.lit(0)).alias("skip")), "parcel-parts")
        rows = rows.join(counts, F.col("parcel.group").eqNullSafe(F.col("c_group")) & (F.col("parcel.part") == F.col("c_part")) & (F.col("sub") == F.col("c_sub"))).withColumn("first", F.col("first") + F.col("skip"))
    return rows.select(*[F.col(f"k_{c}").alias(c) for c in keep], "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
