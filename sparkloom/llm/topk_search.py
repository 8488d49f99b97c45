"""Operator 1: exact top-k search by BM25: inverted lists with block maxima, pruned per shard, merged exactly.

Terms are runs of digits, letters and bytes beyond ASCII, A-Z lower-cased, named by a 64-bit hash.
A query is a row; the registered query asks for all terms of its whole text (``n_terms`` may
shorten it to those of the highest tf x idf, ties by hash). Document frequencies, the number of
rows and their mean length are counted over all rows, so that every shard scores alike.

The index is built once: one row a shard (about ``SHARD_BYTES`` of text) with its terms' postings in
order of term and id, tokenised once and saved. Queries go in blocks of about ``QUERY_BYTES`` of
text, whose terms are broadcast.

Within a shard a query's lists are ordered by length. As in WAND, the longest lists are left out up
to the pivot: as long as the sum of their greatest contributions stays below a part of the query's
threshold, the score of its k-th best row so far. The lists behind the pivot are added up for
many rows at once; a row whose sum and the block maxima (over ``BLOCK`` rows) of the lists left out
do not reach the threshold is dropped, the others get their exact scores. What is dropped cannot be
among the k best, so results are exact.

Shards share thresholds: they are searched in levels of eight times as many shards each, and each
level knows every query's k-th best (score, id) of the levels before. So a level returns about
8 k rows a query however many shards it has, and prunes from its first row on.

Contributions are rounded to multiples of 2^-28, so that sums do not depend on their order and
equal texts have equal scores.

Defined cases: rows without an id ask nothing and are found with a null id; null and empty texts
have no terms, ask nothing and are never found; fewer than k rows share a term: fewer results;
equal scores rank by id; repeated rows are found as often as they are there, and a repeated query
row asks once; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel
from .common import saved, ship, table
from .substring_dedup import FIRST_ID

K, TERMS, K1, B = 10, 16, 1.2, 0.75
SHARD_BYTES, QUERY_BYTES = 10_000_000, 32_000_000
#: Rows of a block; the lists left out are among those that hold at least 1 / DENSE of a shard's rows; part of a threshold that they may reach.
BLOCK, DENSE, SPARE = 64, 16, 0.6
#: Contributions are multiples of this.
GRAIN = 2.0**-28
_plain = np.full(256, 32, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _plain[_c] = ord(chr(_c).lower()) if _c < 128 else _c


def terms(texts: kernel.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of every word."""
    w = kernel.words(kernel.Texts(_plain[texts.data], texts.at))
    return w.text_of(), w.hash


def _counted(text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, tf), in order of text and term."""
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (term[1:] != term[:-1]))[: len(text)])
    return text[first], term[first], np.diff(np.append(first, len(text)))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, tf) of every distinct query row."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in kernel.slices(batches):
            text, term, tf = _counted(*terms(texts))
            yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(text)), pa.array(term.view(np.int64)), pa.array(tf)], names=["qid", "term", "tf"])

    return queries.mapInArrow(emit, "qid bigint, term bigint, tf bigint")


INDEX = "shard bigint, ids binary, sizes binary, terms binary, counts binary, places binary, tfs binary, level int"


def index(rows: DataFrame) -> DataFrame:
    """One row a shard of ``rows`` (id, text): ids and numbers of words of its rows, in order of id; its terms, how many rows each is in, and for every posting the row and tf.

    ``level``: shards in level n + 1 are an eighth of those in level n.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 20
        posts: list[tuple[np.ndarray, ...]] = []
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            base = np.cumsum([0, *(len(i) for i, _ in seen)])
            ids, sizes = (np.concatenate([s[k] for s in seen]) for k in (0, 1))
            by_id = np.argsort(ids, kind="stable")
            place_of = np.empty(len(ids), np.int32)
            place_of[by_id] = np.arange(len(ids), dtype=np.int32)
            place = np.concatenate([place_of[t + b] for (t, _, _), b in zip(posts, base[:-1], strict=True)])
            term, tf = (np.concatenate([p[k] for p in posts]) for k in (1, 2))
            posts.clear()
            order = np.lexsort((place, term))
            term, place, tf = term[order], place[order], tf[order]
            first = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
            spread = int(kernel.mix(np.array([number], np.uint64))[0])
            level = next((k for k in range(12) if (spread >> 3 * k) & 7), 12)
            columns = [ids[by_id], sizes[by_id], term[first], np.diff(np.append(first, len(term))).astype(np.int32), place, tf]
            return pa.RecordBatch.from_arrays([pa.array([number]), *[pa.array([c.tobytes()], pa.binary()) for c in columns], pa.array([level], pa.int32())], names=[c.split()[0] for c in INDEX.split(", ")])

        for batch, texts in kernel.slices(batches):
            text, term = terms(texts)
            size = np.bincount(text, minlength=texts.n).astype(np.int32)
            text, term, tf = _counted(text, term)
            posts.append((text.astype(np.int32), term, tf.astype(np.int32)))
            seen.append((batch.column("id").to_numpy().copy(), size))
            held += len(texts.data)
            if held >= SHARD_BYTES:
                yield flush()
                posts, seen, held, number = [], [], 0, number + 1
        if seen:
            yield flush()

    return rows.mapInArrow(build, INDEX)


def _array(batch: pa.RecordBatch, row: int, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(name)[row].as_buffer(), kind)


def frequencies(shards: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(k, n): in how many rows each of the ``wanted`` (sorted) terms is."""
    sent = shards.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = sent.value
        df = np.zeros(len(want), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                at, own = _within(want, _array(batch, row, "terms", np.uint64))
                df[at] += _array(batch, row, "counts", np.int32)[own]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["k", "n"])

    return shards.select("terms", "counts").mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))


def _within(want: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``want``, place in ``term``) of what both sorted arrays hold."""
    at = np.minimum(np.searchsorted(want, term), len(want) - 1)
    own = np.flatnonzero(want[at] == term) if len(want) else np.zeros(0, np.int64)
    return at[own], own


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[i] .. lo[i] + n[i] - 1 of every i, one after another."""
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


class Shard:
    """Inverted index of one shard: postings in order of term and place (a place is in a list once), and their contributions.

    ``term`` may leave out terms; the lists that hold many of the ``rows`` rows are kept as columns too.
    """

    def __init__(self, place: np.ndarray, term: np.ndarray, score: np.ndarray, n_terms: int, rows: int) -> None:
        self.place, self.score, self.rows = place, score, rows
        self.at = np.searchsorted(term, np.arange(n_terms + 1))
        self.count = np.diff(self.at)
        self.blocks = -(-rows // BLOCK)
        long = np.flatnonzero(self.count >= max(rows / DENSE, 1))
        self.column = np.full(n_terms, -1)
        self.column[long] = np.arange(len(long))
        self.full = np.zeros((len(long), self.blocks * BLOCK))
        for k, t in enumerate(long):
            own = slice(self.at[t], self.at[t + 1])
            self.full[k, place[own]] = score[own]
        self.most = self.full.reshape(len(long), self.blocks, BLOCK).max(axis=2)
        self.top = self.most.max(axis=1) if self.blocks else np.zeros(len(long))

    def search(self, query: np.ndarray, k: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(score, place) of the k best of score ``least`` or more, equal scores by place."""
        left = np.zeros(0, np.int64)
        if least > 0:
            columns = self.column[query]
            some = np.flatnonzero(columns >= 0)
            some = some[np.argsort(-self.count[query[some]], kind="stable")]
            pivot = int(np.searchsorted(np.cumsum(self.top[columns[some]]), SPARE * least))
            left = columns[some[:pivot]]
            query = np.delete(query, some[:pivot])
        n = self.count[query]
        posts = _ranges(self.at[query], n)
        total = np.bincount(self.place[posts], self.score[posts], self.rows)
        if len(left):
            bound = self.most[left].sum(axis=0)
            found = np.flatnonzero((total + np.repeat(bound, BLOCK)[: self.rows]) * (1 + 1e-9) >= least)
            total = total[found] + self.full[np.ix_(left, found)].sum(axis=0)
        else:
            found = np.flatnonzero(total > 0)
            total = total[found]
        if least > 0:
            own = total >= least
            found, total = found[own], total[own]
        if len(total) > k:
            own = total >= np.partition(total, len(total) - k)[len(total) - k]
            found, total = found[own], total[own]
        best = np.lexsort((found, -total))[:k]
        return total[best], found[best]


def search(docs: DataFrame, is_query: Column, k: int = K, n_terms: int | None = TERMS) -> DataFrame:
    """(query_id, rank, doc_id, score): for every row with ``is_query`` its k best rows of all."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST_ID)).alias("id"), "text", (F.col("doc_id").isNotNull() & F.col("text").isNotNull() & is_query).alias("asks"))
    asking = rows.where("asks").select(F.col("id").alias("qid"), "text").distinct()
    size = asking.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    every = saved(query_terms(asking).groupBy("qid", "term").agg(F.max("tf").alias("tf")), "query-terms")
    shards = saved(index(rows.select("id", "text")), "shards", "level")
    sums = shards.agg(F.sum(F.octet_length("ids") / 8).cast("long").alias("rows"), F.collect_set("level").alias("levels")).first()
    words = shards.select("sizes").mapInArrow(_word_sums, "n bigint").agg(F.sum("n")).first()[0] or 0
    out = None
    for block in range(blocks):
        own = every.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block)
        found = _search_block(shards, own, k, n_terms, sums["rows"] or 0, words, sorted(sums["levels"], reverse=True))
        out = found if out is None else out.unionByName(found)
    return out


def _word_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sum(int(_array(batch, row, "sizes", np.int32).sum(dtype=np.int64)) for row in range(batch.num_rows))])], names=["n"])


def _search_block(shards: DataFrame, queries: DataFrame, k: int, n_terms: int | None, rows: int, words: int, levels: list[int]) -> DataFrame:
    spark = shards.sparkSession
    schema = "query_id bigint, id bigint, score double"
    wanted = np.sort(queries.select("term").distinct().toArrow().column("term").to_numpy().view(np.uint64))  # bounded by QUERY_BYTES
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    final = lambda found: found.select("query_id", "rank", F.when(F.col("id") != F.lit(FIRST_ID), F.col("id")).alias("doc_id"), "score")
    if not len(wanted):
        return final(ranked(spark.createDataFrame([], schema)))
    counts = saved(frequencies(shards, wanted), "frequencies")
    names = spark.createDataFrame(pa.table({"k": pa.array(np.arange(len(wanted))), "term": pa.array(wanted.view(np.int64))}))
    idf = F.log(1 + (F.lit(float(rows)) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    chosen = queries.join(names, "term").join(counts, "k").withColumn("idf", idf)
    if n_terms is not None:
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.col("tf") * F.col("idf")), "term"))
        chosen = chosen.withColumn("rank", rank).where(F.col("rank") <= n_terms)
    asked = chosen.select("qid", "k", "idf").toArrow().sort_by([("qid", "ascending"), ("k", "ascending")])  # bounded by QUERY_BYTES
    qid, term, weight = (asked.column(c).to_numpy() for c in ("qid", "k", "idf"))
    used, term = np.unique(term, return_inverse=True)
    weights = np.zeros(len(used))
    weights[term] = weight
    cuts = np.append(np.flatnonzero(np.append(True, qid[1:] != qid[:-1])), len(qid))
    ids = qid[cuts[:-1]]
    sent = spark.sparkContext.broadcast((wanted[used], weights, ids, term.astype(np.int32), cuts, words / max(rows, 1)))
    found = None
    for level in levels:
        least, last = np.zeros(len(ids)), np.full(len(ids), np.iinfo(np.int64).max)
        if found is not None:  # bounded by QUERY_BYTES: one row a query
            kth = found.where(F.col("rank") == k).select("query_id", "score", "id").toArrow()
            at = np.searchsorted(ids, kth.column("query_id").to_numpy())
            least[at], last[at] = kth.column("score").to_numpy(), kth.column("id").to_numpy()
        more = shards.where(F.col("level") == level).drop("level").mapInArrow(_finder(sent, spark.sparkContext.broadcast((least, last)), k), schema)
        more = more if found is None else found.drop("rank").unionByName(more)
        found = saved(ranked(more), f"level-{level}")
    return final(found)


def _finder(sent, limits, k: int):
    """Searches the shards of its batches for all queries of a block; returns what may be among the k best."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, idf, qids, asked, cuts, mean = sent.value
        least, last = limits.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, size = _array(batch, row, "ids", np.int64), _array(batch, row, "sizes", np.int32)
                counts = _array(batch, row, "counts", np.int32).astype(np.int64)
                at, own = _within(want, _array(batch, row, "terms", np.uint64))
                posts = _ranges((np.cumsum(counts) - counts)[own], counts[own])
                place, tf = _array(batch, row, "places", np.int32)[posts], _array(batch, row, "tfs", np.int32)[posts]
                term = np.repeat(at, counts[own])
                score = np.rint(idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[place] / max(mean, 1e-9))) / GRAIN) * GRAIN
                shard = Shard(place, term, score, len(want), len(ids))
                q, d, s = [], [], []
                for n, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    points, places = shard.search(asked[a:b], k, least[n])
                    if len(places):
                        own = (points > least[n]) | (ids[places] < last[n])
                        q.append(np.full(int(own.sum()), qids[n]))
                        d.append(ids[places][own])
                        s.append(points[own])
                if q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (q, d, s)], names=["query_id", "id", "score"])

    return find


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), F.col("doc_id") % 100 == 0, n_terms=None)


def brute_force(rows: list[tuple[int, str | None]], k: int = K, n_terms: int | None = TERMS) -> list[tuple[int, int, int, float]]:
    """The same by scoring every row for every query; for tests."""
    import math
    import re
    from collections import Counter

    def hashed(word: bytes) -> int:
        data = np.frombuffer(word, np.uint8)
        return int(kernel.Spans(data).hashes(np.array([0]), np.array([len(data)]))[0])

    bags = [Counter(x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))) for _, t in rows]
    names = {w: hashed(w) for bag in bags for w in bag}
    df = Counter(w for bag in bags for w in bag)
    n, mean = len(rows), sum(sum(b.values()) for b in bags) / max(len(rows), 1)
    idf = {w: math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for q, bag in {i: b for (i, t), b in zip(rows, bags, strict=True) if i is not None and i % 100 == 0 and t is not None}.items():
        ask = sorted(bag, key=lambda w: (-bag[w] * idf[w], signed(names[w])))[:n_terms]
        found = []
        for (i, _), other in zip(rows, bags, strict=True):
            size = sum(other.values())
            hit = [w for w in sorted(ask, key=lambda w: names[w]) if w in other]
            if hit:
                found.append((sum(round(idf[w] * other[w] * (K1 + 1) / (other[w] + K1 * (1 - B + B * size / mean)) / GRAIN) * GRAIN for w in hit), i))
        found.sort(key=lambda x: (-x[0], x[1]))
        out += [(q, r, i, s) for r, (s, i) in enumerate(found[:k], 1)]
    return out
