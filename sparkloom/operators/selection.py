"""Ranked selection: caps per key, greedy suppression of near repeats, best match."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key; the limit reaches the scan side of the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def greedy_select(df: DataFrame, key: str, order: str, tokens: str, most: int = 12, near: float = 0.85) -> DataFrame:
    """Per key, rows in order while fewer than ``most`` are kept, without those whose tokens are near a kept row's of the same key.

    A key's rows come sorted through one task, batch by batch; what is held at a time is a batch and the kept rows' tokens.
    """

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = object(), []
        for rows in batches:
            out = []
            for i, (k, own) in enumerate(zip(rows[key], rows[tokens], strict=True)):
                if k != last and not (pd.isna(k) and pd.isna(last)):
                    last, kept = k, []
                if len(kept) < most:
                    own = set(own)
                    if all(len(own & x) < near * max(1, len(own | x)) or not own or not x for x in kept):
                        kept.append(own)
                        out.append(i)
            yield rows.iloc[out]

    return df.repartition(key).sortWithinPartitions(key, order).mapInPandas(pick, df.schema)


def best_match(statements: DataFrame, known: DataFrame, block: str, tokens: str, order: str, least: float = 0.35) -> DataFrame:
    """For each statement the most similar known record of its block at ``least`` or more; the first by ``order`` on ties.

    Statements alike and records alike are compared once.
    """
    k = known.groupBy(block, F.col(tokens).alias("_t")).agg(F.min(order).alias("match"))
    s = statements.select(block, tokens).distinct().join(k, block).withColumn("similarity", jaccard(F.col(tokens), F.col("_t"))).where(F.col("similarity") >= least)
    best = lambda d, *own: d.withColumn("_k", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("similarity"), F.asc_nulls_last("match")))).where("_k = 1").drop("_k", "_t")
    found = statements.join(best(s, block, tokens), [block, tokens])
    return best(found, statements.columns[0]).select(block, *[c for c in statements.columns if c != block], "match", "similarity")
