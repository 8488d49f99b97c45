"""Classes of linked items: candidate groups, exact joins within them, and what joins large groups.

Items that share a token may be linked. The tokens' groups are connected into candidate classes
(one star of edges a token, so their number follows the tokens and not the pairs), every item's
payload goes to its class once, and there ``join`` finds the true links. A class of more than
``LARGE`` items or ``LARGE_BYTES`` is dealt into blocks: each block is joined with a few common
pivots, then the items outside the largest linked part ask, block by block, all blocks. So every
two items of a class have been compared or are connected, and no task holds a whole class.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

LARGE, LARGE_BYTES, ASKING, PIVOTS = 3000, 6_000_000, 1000, 24
#: Bytes of payload in one task.
BIN_BYTES = 12_000_000

#: Payloads, and which of them ask (all where that is None) -> for each payload the index of its part's first.
Join = Callable[[list[bytes], list[bool] | None], list[int]]


class Sets:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.lit(0))).first())


#: Edges of one file of a step.
FILE_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (src, dst); root is the least node of its component.

    Alternating large-star and small-star steps; each step's edges are saved, in files that follow their number, and
    never exceed the first's. So are the nodes' least neighbours: then the join to them has one row a node on its one
    side, and Spark can split a node with very many edges on the other (skew join).
    """
    edges = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    edges = saved(edges, "edges")
    before = _sum(edges)
    while before[0]:
        step = lambda df, tag, n=before[0]: saved(df.coalesce(max(1, -(-n // FILE_EDGES))), tag)
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = step(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("s"), F.least("src", "m").alias("m")), "least")
        large = both.where("dst > src").join(least, F.col("src") == F.col("s")).select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        large = step(large, "large-star")
        least = step(large.groupBy("src").agg(F.min("dst").alias("m")).withColumnRenamed("src", "s"), "least")
        small = large.join(least, F.col("src") == F.col("s")).select(F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")), F.struct("src", F.col("m").alias("dst")))).alias("e")).select("e.*")
        edges = step(small.where("src <> dst").distinct(), "edges")
        now = _sum(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(edges.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())


def candidates(tokens: DataFrame) -> DataFrame:
    """(node, comp) of nodes that share a token with another. ``tokens``: (token, node)."""
    tokens = saved(tokens.distinct(), "tokens")
    shared = tokens.groupBy("token").agg(F.min("node").alias("dst"), F.max("node").alias("most")).where("dst < most").select(F.col("token").alias("t"), "dst")
    return components(tokens.join(shared, F.col("token") == F.col("t")).select(F.col("node").alias("src"), "dst")).withColumnRenamed("root", "comp")


def _joined(join: Join) -> Callable[[pa.Table], pa.Table]:
    """Items of one or several classes of a group -> (src, dst), dst an item of the same linked part."""

    def links(rows: pa.Table) -> pa.Table:
        comp, node = rows.column("comp").to_numpy(), rows.column("node").to_numpy()
        order = np.lexsort((node, comp))
        comp, node, payload = comp[order], node[order], rows.column("payload").take(pa.array(order))
        asks = rows.column("asks").to_numpy()[order] if "asks" in rows.column_names else None
        src, dst = [], []
        cuts = np.append(np.flatnonzero(np.append(True, comp[1:] != comp[:-1])), len(comp))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for k, up in enumerate(join([x.as_py() for x in payload.slice(a, b - a)], asks[a:b].tolist() if asks is not None else None)):
                src.append(node[a + k])
                dst.append(node[a + up])
        return pa.table([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], schema=pa.schema([("src", pa.int64()), ("dst", pa.int64())]))

    return links


def _upto(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint") - 1))


def link(items: DataFrame, tokens: DataFrame, join: Join) -> DataFrame:
    """(node, root) of every item of ``items`` (node, payload) that may be linked; root is an item of its linked part.

    Nodes are unique in ``items``. ``join`` takes payloads and returns, for each, the index of its part's first.
    """
    out = "src bigint, dst bigint"
    comps = candidates(tokens)
    sizes = comps.join(items.select("node", F.octet_length("payload").alias("bytes")), "node").groupBy("comp").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes"))
    sizes = sizes.withColumn("blocks", F.ceil(F.greatest(F.col("size") / LARGE, F.col("bytes") / LARGE_BYTES)).cast("int"))
    large = saved(sizes.where((F.col("blocks") > 1) & (F.col("size") > 2)), "large")
    members = items.join(comps, "node")
    total = items.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    parts = int(max(1, total // BIN_BYTES, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    small = members if large.isEmpty() else members.join(large.select("comp"), "comp", "left_anti")
    small = small.withColumn("bin", F.pmod(F.xxhash64("comp"), F.lit(4 * parts)))
    links = small.groupBy("bin").applyInArrow(_joined(join), out)
    if large.isEmpty():
        return links.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    own = saved(members.join(large, "comp"), "large-members").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    pivots = own.where(F.pmod(F.xxhash64("node", F.lit(1)), F.col("size")) < PIVOTS).withColumn("block", _upto("blocks"))
    columns = ["comp", "block", "node", "payload"]
    first = own.select(*columns).unionByName(pivots.select(*columns)).dropDuplicates(["comp", "block", "node"])
    edges = saved(first.groupBy("comp", "block").applyInArrow(_joined(join), out), "links")
    roots = components(edges)
    marked = saved(own.select("comp", "node", "block", "blocks").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    main = marked.groupBy("comp", "root").count().groupBy("comp").agg(F.max(F.struct("count", "root"))["root"].alias("main"))
    rest = saved(marked.join(main, "comp").where("root <> main").select("comp", "node", "blocks"), "rest")
    counts = saved(rest.groupBy("comp", "blocks").agg(F.count("*").alias("n")).join(large.select("comp", "size"), "comp").select("comp", F.ceil(F.greatest(F.col("n") / ASKING, F.col("blocks") * F.col("n") / F.col("size"))).cast("int").alias("parts")), "rest-sizes")
    rest = rest.join(counts, "comp").withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")))
    ask = rest.join(own.select("node", "payload"), "node").withColumn("block", _upto("blocks"))
    told = own.join(counts, "comp").withColumn("part", _upto("parts"))
    columns = ["comp", "block", "part", "node", "payload", "asks"]
    second = ask.withColumn("asks", F.lit(True)).select(*columns).unionByName(told.withColumn("asks", F.lit(False)).select(*columns))
    more = second.groupBy("comp", "block", "part").applyInArrow(_joined(join), out)
    roots = components(saved(edges.unionByName(more), "links"))
    alone = own.select("node").join(roots.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    return links.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(roots).unionByName(alone)
