"""Operator 5: line dedup by a segment-partition edit join.

Lines are the parts of a text between newlines. Two lines of ``MIN_CHARS`` characters (code points) or
more are near if at most ``EDITS`` edits of a character lead from one to the other; shorter lines
only if equal, as two edits in a few words often make another sentence.
Of each class of lines that are linked by equality or nearness, by any chain, the first line
stays, by (doc_id, line number); blank lines stay all.

A line of length L is cut into EDITS + 1 segments, of which a line within EDITS edits must hold one
unchanged, at a place that the lengths confine. Every line's segments and the substrings that it
must probe for lengths L - EDITS to L are hashed from prefix sums; the keys are counted packed,
by bucket, and only lines whose key occurs in another line go on: they are grouped by shared
keys (``linking``) and compared by a bit-parallel automaton that holds only the 2 x EDITS + 1
diagonals around the main one, one word for each number of edits.

Defined cases: a null text has no lines; lines of white space are blank; rows that repeat id and text
are one document and each comes back; rows that share only an id are ordered by a hash of
the text; a null id comes first; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel, linking
from .common import release, saved, ship, table
from .substring_dedup import bucket_count, keyed

EDITS, MIN_CHARS = 2, 32
BUCKET_BYTES = 30_000_000


def lines(texts: kernel.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, number, start, end) of every line that is not blank, of texts as bytes or as code points."""
    brk = np.flatnonzero(texts.data == 10)
    some = np.flatnonzero(np.diff(texts.at) > 0)
    start = np.sort(np.concatenate([texts.at[:-1][some], brk + 1]))
    end = np.sort(np.concatenate([texts.at[1:][some], brk]))
    text = np.searchsorted(texts.at, start, "right") - 1
    # a text that ends in a newline: the empty line after it starts where the next text does
    order = np.argsort(start * 2 + (end > start), kind="stable")
    start, end, text = start[order], end[order], text[order]
    some = np.flatnonzero(end > start)
    nine = texts.data.dtype.type(9)  # numbers below it wrap around
    ink = (texts.data != 32) & (texts.data - nine > 4)
    own = np.zeros(len(start), bool)
    if len(some):
        # each line with its newline, which is no ink, runs up to the next line
        own[some] = np.logical_or.reduceat(ink, start[some])
    number = np.searchsorted(brk, start) - np.searchsorted(brk, texts.at[text])
    return text[own], number[own], start[own], end[own]


def probes(spans: kernel.Spans, start: np.ndarray, end: np.ndarray, edits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, key): a key for each segment of each length that a partner may have, at each place where it may stand. Its own segments are among them."""
    size, parts = end - start, edits + 1
    of, keys = [], []
    for less in range(edits + 1):
        own = np.flatnonzero(size - less >= least)
        length = size[own] - less
        short, longer = length // parts, length % parts
        for i in range(parts):  # the last ``longer`` segments have one character more
            at = i * short + np.maximum(0, i - (parts - longer))
            wide = short + (i >= parts - longer)
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                here = start[own] + at + shift
                ok = (at + shift >= 0) & (here + wide <= end[own])
                found = spans.hashes(here[ok], (here + wide)[ok])
                keys.append(kernel.mix(found + (length[ok] * parts + i).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
                of.append(own[ok])
    return np.concatenate(of), np.concatenate(keys)


def within(a: str, b: str, edits: int) -> bool:
    """Whether at most ``edits`` edits of a character lead from a to b."""
    if abs(len(a) - len(b)) > edits:
        return False
    at = 0
    least = min(len(a), len(b))
    while at + 16 <= least and a[at : at + 16] == b[at : at + 16]:
        at += 16
    a, b = a[at:], b[at:]
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k + edits
    full = (1 << 2 * edits + 1) - 1
    # bit edits + d of state[e]: after j characters of b, the first j + d of a are reached with e edits
    state = [((1 << e + 1) - 1) << edits for e in range(edits + 1)]
    size = len(a)
    for j, c in enumerate(b):
        match = where.get(c, 0) >> j & full
        room = full if j + 1 + edits <= size else full & ((1 << max(size - j - 1 + edits + 1, 0)) - 1)
        new: list[int] = []
        for e in range(edits + 1):
            s = state[e] & match
            if e:
                s |= state[e - 1] | state[e - 1] >> 1 | new[e - 1] << 1
            new.append(s & room)
        if not new[edits]:
            return False
        state = new
    return bool(state[edits] >> (len(a) - len(b) + edits) & 1)


def edit_join(payloads: list[bytes], edits: int, least: int, asks: list[bool] | None = None) -> list[int]:
    """For each line, the index of the first of its class of near lines. Compares lines that share a key and are not connected yet."""
    texts = [p.decode("utf-8", "surrogatepass") for p in payloads]
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - np.array([len(t) for t in texts])
    of, keys = probes(kernel.Spans(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)), starts, ends, edits, least)
    order = np.lexsort((of, keys))
    of, keys = of[order], keys[order]
    cuts = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
    parts, seen = linking.Sets(len(payloads)), set()
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi - lo < 2:
            continue
        own = list(dict.fromkeys(of[lo:hi].tolist()))
        for x, a in enumerate(own):
            for b in own[:x]:
                if (asks is None or asks[a] or asks[b]) and (a, b) not in seen and parts.find(a) != parts.find(b):
                    seen.add((a, b))
                    if within(texts[a], texts[b], edits):
                        parts.union(a, b)
    return [parts.find(k) for k in range(len(payloads))]


def line_table(rows: DataFrame) -> DataFrame:
    """(h, id, tag, line): every line that is not blank, by its hash."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in kernel.slices(batches):
            texts = kernel.characters(raw)
            text, number, start, end = lines(texts)
            h = kernel.Spans(texts.data).hashes(start, end)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("id").take(pa.array(text)), batch.column("tag").take(pa.array(text)), pa.array(number.astype(np.int32))], names=["h", "id", "tag", "line"])

    return rows.select("id", "tag", "text").mapInArrow(emit, "h bigint, id bigint, tag bigint, line int")


def probable(rows: DataFrame, edits: int, least: int, buckets: int) -> DataFrame:
    """(h): lines that share a key with another line."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw in kernel.slices(batches):
            texts = kernel.characters(raw)
            _, _, start, end = lines(texts)
            spans = kernel.Spans(texts.data)
            h, first = np.unique(spans.hashes(start, end), return_index=True)
            of, keys = probes(spans, start[first], end[first], edits, least)
            bucket = (keys >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket.astype(np.uint32), kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = [{"bucket": int(b), "keys": keys[o].tobytes(), "lines": h[of[o]].tobytes()} for b in np.flatnonzero(np.diff(cuts)) for o in [order[cuts[b] : cuts[b + 1]]]]
            if out:
                yield kernel.to_batch(out, pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("lines", pa.binary())]))

    def judge(rows: pa.Table) -> pa.Table:
        get = lambda name: np.frombuffer(b"".join(x.as_py() for c in rows.column(name).chunks for x in c), np.uint64)
        keys, h = get("keys"), get("lines")
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        own = order[np.append(same, False) | np.append(False, same)]
        own = own[np.lexsort((h[own], keys[own]))]
        k, x = keys[own], h[own]
        group = np.cumsum(np.append(True, k[1:] != k[:-1])[: len(k)]) - 1
        differ = np.append(False, (k[1:] == k[:-1]) & (x[1:] != x[:-1]))[: len(k)]
        some = np.bincount(group, differ) > 0 if len(group) else np.zeros(0, bool)
        found = np.unique(x[some[group]]) if len(group) else x
        return pa.table([pa.array(found.view(np.int64))], names=["h"])

    packed = rows.select("text").mapInArrow(emit, "bucket int, keys binary, lines binary").repartition(buckets, "bucket")
    return packed.groupBy("bucket").applyInArrow(judge, "h bigint").distinct()


def _with_texts(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``rows`` with the ``lines`` of ``places`` (id, tag, line), null where there are none."""
    places = places.groupBy("id", "tag").agg(F.collect_set("line").alias("lines")).withColumnsRenamed({"id": "p_id", "tag": "p_tag"})
    return rows.join(places, (F.col("id") == F.col("p_id")) & (F.col("tag") == F.col("p_tag")), "left")


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_lines (not blank), n_removed, n_near (removed lines that equal no earlier line) and ``kept``, the text left."""
    spark = docs.sparkSession
    ship(spark)
    rows = keyed(docs, id_col)
    every = saved(line_table(rows), "lines")
    firsts = saved(every.groupBy("h").agg(F.min(F.struct("id", "tag", "line")).alias("first"), F.count("*").alias("n")), "firsts")
    likely = saved(probable(rows, edits, least, bucket_count(docs, BUCKET_BYTES)), "probable")
    release(spark)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in kernel.slices(batches):
            texts = kernel.characters(raw)
            text, number, start, end = lines(texts)
            spans = kernel.Spans(texts.data)
            wanted = batch.column("lines").to_pylist()
            flat = np.array([(k << 32) + n for k, w in enumerate(wanted) if w for n in w], np.int64)
            own = np.isin((text.astype(np.int64) << 32) + number, flat)
            start, end = start[own], end[own]
            h = spans.hashes(start, end)
            of, keys = probes(spans, start, end, edits, least)
            order = np.argsort(of, kind="stable")
            at = np.searchsorted(of[order], np.arange(len(start) + 1))
            tokens = keys[order].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([texts.data[a:b].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass") for a, b in zip(start, end, strict=True)], pa.binary()), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens))], names=["node", "payload", "tokens"])

    def likely_items() -> DataFrame:  # nothing else holds the texts' shuffle, so that it goes with ``release``
        wanted = firsts.join(likely, "h").select("first.id", "first.tag", "first.line")
        texts = _with_texts(rows, wanted).where("lines is not null").select("text", "lines").mapInArrow(take, "node bigint, payload binary, tokens array<bigint>")
        return saved(texts.dropDuplicates(["node"]), "items")

    items = likely_items()
    release(spark)
    roots = linking.link(items.select("node", "payload"), items.select(F.explode("tokens").alias("token"), "node"), lambda payloads, asks: edit_join(payloads, edits, least, asks))
    near = roots.join(firsts, F.col("node") == F.col("h")).select("node", "root", "first")
    lead = near.groupBy("root").agg(F.min("first").alias("lead"), F.count("*").alias("m")).where("m > 1")
    near = saved(near.join(lead, "root").select(F.col("node").alias("n_h"), "lead"), "near-lines")
    places = firsts.join(near, F.col("h") == F.col("n_h"), "left").where("n > 1 or lead is not null").select("h", "first", F.coalesce("lead", "first").alias("lead"))
    places = saved(places, "line-places")  # one row a line: Spark can split a very common line on the other side of the join
    gone = every.join(places, "h").where(F.struct("id", "tag", "line") != F.col("lead")).select("id", "tag", F.when(F.struct("id", "tag", "line") == F.col("first"), -1 - F.col("line")).otherwise(F.col("line")).alias("line"))
    gone = saved(gone, "gone")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in kernel.slices(batches):
            text, *_ = lines(texts)
            n_lines = np.bincount(text, minlength=texts.n)
            n_gone, n_near, out = [], [], []
            for k, marks in enumerate(batch.column("lines").to_pylist()):
                marks = marks or []
                drop = {m if m >= 0 else -1 - m for m in marks}
                out.append(b"\n".join(x for i, x in enumerate(texts.bytes_of(k).split(b"\n")) if i not in drop).decode())
                n_gone.append(len(drop))
                n_near.append(sum(m < 0 for m in marks))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("is_null"), pa.array(n_lines.astype(np.int64)), pa.array(n_gone, pa.int64()), pa.array(n_near, pa.int64()), pa.array(out, pa.string())], names=["id", "is_null", "n_lines", "n_removed", "n_near", "kept"])

    out = _with_texts(rows, gone).select("id", "is_null", "text", "lines").mapInArrow(kept, "id bigint, is_null boolean, n_lines bigint, n_removed bigint, n_near bigint, kept string")
    return out.select(F.when(~F.col("is_null"), F.col("id")).alias(id_col), "n_lines", "n_removed", "n_near", "kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "n_near", F.sha2("kept", 256).alias("kept_sha256"))


def distance(a: str, b: str) -> int:
    """Plain dynamic programming; for tests."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_force(rows: list[tuple[int, str | None]], edits: int = EDITS, least: int = MIN_CHARS) -> list[tuple[int, int, int, int, str]]:
    """The same by comparing all pairs of distinct lines; for tests."""
    import hashlib
    from collections import Counter

    blank = kernel.SPACES.decode()
    docs = [(i, t.split("\n") if t is not None else []) for i, t in rows]
    first: dict[str, tuple[int, int]] = {}
    for i, own in docs:
        for n, x in enumerate(own):
            if x.strip(blank):
                first[x] = min(first.get(x, (i, n)), (i, n))
    distinct = sorted(first, key=len)
    parts = linking.Sets(len(distinct))
    bags = [Counter(x) for x in distinct]
    for b, y in enumerate(distinct):
        for a in range(b - 1, -1, -1):
            x = distinct[a]
            if len(y) - len(x) > edits or len(x) < least:
                break
            if (bags[a] - bags[b]).total() + (bags[b] - bags[a]).total() <= 2 * edits and distance(x, y) <= edits:  # an edit moves two counts at most
                parts.union(a, b)
    lead: dict[int, tuple[int, int]] = {}
    for k, x in enumerate(distinct):
        lead[parts.find(k)] = min(lead.get(parts.find(k), first[x]), first[x])
    of = {x: lead[parts.find(k)] for k, x in enumerate(distinct)}
    out = []
    for i, own in docs:
        real = [n for n, x in enumerate(own) if x.strip(blank)]
        gone = [n for n in real if of[own[n]] != (i, n)]
        near = [n for n in gone if first[own[n]] == (i, n)]
        kept = "\n".join(x for n, x in enumerate(own) if n not in set(gone))
        out.append((i, len(real), len(gone), len(near), hashlib.sha256(kept.encode()).hexdigest()))
    return out
