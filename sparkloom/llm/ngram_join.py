"""Operator 9: n-gram Jaccard join by prefix trees.

A document's set holds the hashes of its distinct word n-grams, in the one global order of hashes.
Two sets whose Jaccard similarity reaches t = ``num`` / ``den`` share about (1 - t) n of their first
2 (1 - t) n grams. These first grams are counted over all documents, packed by bucket, and a
document is left out unless so many of them occur in another document. The others name, of
their first grams, the rarest: as many as a partner cannot all lack. Documents that share
one are grouped and joined (``linking``). The
join keeps the ordered sets in a path-compressed trie and lets each set descend, so that what
overlaps with a common path is counted once; a subtree is left when its sizes are out of reach,
when the overlap so far and what remains on either side stay below the need, or when all its
sets are already in the asker's class.

Sets are made of 64-bit hashes (two grams of one document meet by chance once in 10^13 documents of
a thousand grams); equal sets are one node, named by a 64-bit hash of the set.

Defined cases: null, empty or wordless texts have an empty set and stand alone; texts with fewer
than n words have their whole sequence as one gram; rows that repeat id and text are one
document and each comes back; rows without an id link like others but never name a class (one of
such rows alone has no component_id); an empty table gives no rows; other columns are not
looked at.
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

GRAM, NUM, DEN = 4, 85, 100
BUCKET_BYTES = 80_000_000


def shingles(texts: kernel.Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every text's distinct n-grams, in order of text and hash."""
    w = kernel.words(kernel.Texts(kernel.lowered(texts.data), texts.at))
    text = w.text_of()
    keys = kernel.windows(w.hash, n)
    own = text[: len(keys)] == text[len(text) - len(keys) :]
    keys, of = keys[own], text[: len(keys)][own]
    count = np.diff(w.at)
    for k in np.flatnonzero((count > 0) & (count < n)):
        part = w.hash[w.at[k] : w.at[k + 1]]
        keys, of = np.append(keys, kernel.windows(part, len(part)) ^ np.uint64(len(part))), np.append(of, k)
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1]))[: len(keys)]
    return of[new], keys[new]


def first_grams(size: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(how many first grams are compared, how many of them any partner shares at least) for sets of these sizes."""
    spare = size - -(-num * size // den)  # grams that a partner may lack
    least = -(-num * size // den)  # a partner's least size
    need = 1 + (least - -(-num * least // den))
    return np.minimum(size, 2 * spare + 1), np.minimum(size, need)


def shared_grams(rows: DataFrame, n: int, num: int, den: int, buckets: int) -> DataFrame:
    """(id, tag, a, b): a text's first grams that are first grams of another text too, and in how many they are (up to 65535)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in kernel.slices(batches):
            text, keys = shingles(texts, n)
            size = np.bincount(text, minlength=texts.n)
            rank = np.arange(len(text)) - np.searchsorted(text, text)
            own = rank < first_grams(size, num, den)[0][text]
            found = list(kernel.pack(batch.column("id").to_numpy(), batch.column("tag").to_numpy(), text[own], keys[own], None, buckets))
            if found:
                yield kernel.to_batch(found, kernel.PACKED_ARROW)

    def count(rows: pa.Table) -> pa.Table:
        packed = kernel.unpack(rows)
        own = kernel.repeated(packed.keys)
        i, t = packed.owners(own)
        k = packed.keys[own]
        del packed
        order = np.lexsort((t, i, k))
        k, i, t = k[order], i[order], t[order]
        new_key = np.append(True, k[1:] != k[:-1])[: len(k)]
        new = new_key | np.append(True, (i[1:] != i[:-1]) | (t[1:] != t[:-1]))[: len(k)]
        k, i, t = k[new], i[new], t[new]  # a repeated row is no other text
        group = np.cumsum(np.append(True, k[1:] != k[:-1])[: len(k)]) - 1
        often = np.bincount(group)[group] if len(group) else group
        many = often > 1
        return kernel.reply(i[many], t[many], k[many], np.minimum(often[many], 65535).astype(np.uint16), buckets)

    packed = rows.select("id", "tag", "text").mapInArrow(emit, kernel.PACKED).repartition(buckets, "bucket")
    found = packed.groupBy("bucket").applyInArrow(count, kernel.REPLY)
    return found.repartition(buckets, "dest").groupBy("dest").applyInArrow(kernel.gather("uint64", "uint16"), kernel.GATHERED)


class _Node:
    __slots__ = ("least", "leaves", "more", "most", "part", "rest")

    def __init__(self, part: np.ndarray, least: int, most: int, rest: int) -> None:
        self.part, self.more, self.leaves = part, {}, []
        self.least, self.most, self.rest = least, most, rest  # sizes of the sets below, and the most grams below


def _insert(root: _Node, x: np.ndarray, me: int) -> None:
    node, at, size = root, 0, len(x)
    while at < size:
        sub = node.more.get(int(x[at]))
        if sub is None:
            sub = node.more[int(x[at])] = _Node(x[at:], size, size, 0)
            node = sub
            break
        tail = x[at : at + len(sub.part)]
        same = sub.part[: len(tail)] == tail
        k = len(tail) if same.all() else int(same.argmin())
        if k < len(sub.part):  # part the path
            upper = _Node(sub.part[:k], sub.least, sub.most, sub.rest + len(sub.part) - k)
            sub.part = sub.part[k:]
            upper.more[int(sub.part[0])] = sub
            node.more[int(x[at])] = sub = upper
        sub.least, sub.most = min(sub.least, size), max(sub.most, size)
        sub.rest = max(sub.rest, size - at - k)
        at, node = at + k, sub
    node.leaves.append(me)


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[i] .. lo[i] + n[i] - 1 of every i, one after another."""
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


class _Trie:
    """A built trie as arrays, nodes level by level: children of a node stand together, and each gram knows its nodes."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        root = _Node(np.zeros(0, np.uint64), 0, 0, 0)
        for me, x in enumerate(sets):
            _insert(root, x, me)
        nodes, k = [root], 0
        child, many = [], []
        while k < len(nodes):
            child.append(len(nodes))
            nodes += nodes[k].more.values()
            many.append(len(nodes) - child[k])
            k += 1
        self.child, self.many = np.array(child), np.array(many)
        self.least, self.most, self.rest = (np.array([getattr(x, n) for x in nodes]) for n in ("least", "most", "rest"))
        self.last = np.array([x.part[-1] if len(x.part) else 0 for x in nodes], np.uint64)
        grams = np.concatenate([x.part for x in nodes])
        order = np.argsort(grams, kind="stable")
        self.node = np.repeat(np.arange(len(nodes)), [len(x.part) for x in nodes])[order]
        self.grams, first = np.unique(grams[order], return_index=True)
        self.at = np.append(first, len(grams))
        self.leaf = np.array([i for x in nodes for i in x.leaves])
        self.leaf_at = np.append(0, np.cumsum([len(x.leaves) for x in nodes]))
        self.size = np.array([len(x) for x in sets])

    def partners(self, x: np.ndarray, num: int, den: int) -> np.ndarray:
        """Sets that x is linked with, itself included."""
        size = len(x)
        least = -(-num * size // den)
        place = np.minimum(np.searchsorted(self.grams, x), len(self.grams) - 1)
        place = place[self.grams[place] == x]
        own = np.bincount(self.node[_ranges(self.at[place], self.at[place + 1] - self.at[place])], minlength=len(self.last))
        found = []
        front, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(front):
            n = self.many[front]
            overlap, front = np.repeat(overlap, n), _ranges(self.child[front], n)
            overlap = overlap + own[front]
            fit = (self.most[front] >= least) & (self.least[front] * num <= size * den)
            need = -(-num * (size + np.maximum(self.least[front], least)) // (num + den))
            fit &= overlap + np.minimum(size - np.searchsorted(x, self.last[front], "right"), self.rest[front]) >= need
            front, overlap = front[fit], overlap[fit]
            n = self.leaf_at[front + 1] - self.leaf_at[front]
            leaf, here = self.leaf[_ranges(self.leaf_at[front], n)], np.repeat(overlap, n)
            found.append(leaf[here * den >= num * (size + self.size[leaf] - here)])
        return np.concatenate(found)


def trie_join(sets: list[np.ndarray], num: int, den: int, asks: list[bool] | None = None) -> list[int]:
    """For each ordered set, the index of the first of its class of linked sets. With ``asks`` only those sets are compared to all."""
    parts = linking.Sets(len(sets))
    if len(sets) > 1:
        trie = _Trie(sets)
        for me, x in enumerate(sets):
            if asks is None or asks[me]:
                found = trie.partners(x, num, den)
                for other in (found[found < me] if asks is None else found).tolist():
                    parts.union(me, other)
    return [parts.find(k) for k in range(len(sets))]


def packed_text(text: bytes) -> bytes:
    """Length and zstd: a text is smaller than its set of hashes."""
    return len(text).to_bytes(4, "little") + pa.compress(text, codec="zstd", asbytes=True)


def unpacked_sets(payloads: list[bytes], n: int) -> list[np.ndarray]:
    """The ordered sets of packed texts, some texts at a time."""
    out: list[np.ndarray] = []
    k = 0
    while k < len(payloads):
        texts, held = [], 0
        while k < len(payloads) and held < kernel.SLICE_BYTES:
            size = int.from_bytes(payloads[k][:4], "little")
            texts.append(pa.decompress(payloads[k][4:], size, codec="zstd", asbytes=True))
            held, k = held + size, k + 1
        at = np.append(0, np.cumsum([len(t) for t in texts]))
        text, keys = shingles(kernel.Texts(np.frombuffer(b"".join(texts), np.uint8), at), n)
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        out += [keys[i:j].copy() for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return out


SETS = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("is_null", pa.bool_()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("first", pa.list_(pa.int64())), ("payload", pa.binary())])


def near_classes(docs: DataFrame, n: int = GRAM, num: int = NUM, den: int = DEN, id_col: str = "doc_id", names: bool = False) -> DataFrame:
    """Per row: id, n_shingles and component_id, the least id of those it is linked with by any chain.

    With ``names``: per row id and tag as ``keyed`` gives them, and whether it is its class's first (``stays``).
    """
    spark = docs.sparkSession
    ship(spark)
    rows = keyed(docs, id_col)
    shared = saved(shared_grams(rows, n, num, den, bucket_count(docs, BUCKET_BYTES)), "shared")
    release(spark)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in kernel.slices(batches):
            text, keys = shingles(texts, n)
            size = np.bincount(text, minlength=texts.n)
            need = first_grams(size, num, den)[1]
            grams, often = batch.column("a"), batch.column("b")
            at = np.append(0, np.cumsum(size))
            digest = np.bitwise_xor.reduceat(np.append(kernel.mix(keys), np.uint64(0)), np.minimum(at[:-1], len(keys))) if texts.n else keys
            first, payload, node = [], [], []
            for k in range(texts.n):
                mine = np.frombuffer(grams[k].as_py() or b"", np.uint64)
                if size[k] and len(mine) >= need[k]:
                    rare = np.lexsort((mine, np.frombuffer(often[k].as_py(), np.uint16)))
                    first.append(mine[rare[: len(mine) - need[k] + 1]].view(np.int64))
                    payload.append(packed_text(texts.bytes_of(k)))
                    node.append(int(kernel.mix(digest[k : k + 1] + np.uint64(size[k])).view(np.int64)[0]))
                else:
                    first.append(None)
                    payload.append(None)
                    node.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), batch.column("is_null"), pa.array(size.astype(np.int64)), pa.array(node, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(payload, pa.binary())], schema=SETS)

    def with_sets() -> DataFrame:  # nothing else holds the texts' shuffle, so that it goes with ``release``
        joined = rows.join(shared.withColumnsRenamed({"id": "s_id", "tag": "s_tag"}), (F.col("id") == F.col("s_id")) & (F.col("tag") == F.col("s_tag")), "left")
        return saved(joined.select("id", "tag", "is_null", "text", "a", "b").mapInArrow(sets, "id bigint, tag bigint, is_null boolean, n_shingles bigint, node bigint, first array<bigint>, payload binary"), "sets")

    found = with_sets()
    release(spark)
    kept = found.where("node is not null")
    items = kept.select("node", "payload").dropDuplicates(["node"])
    tokens = kept.select("node", F.explode("first").alias("token"))
    links = saved(linking.link(items, tokens, lambda payloads, asks: trie_join(unpacked_sets(payloads, n), num, den, asks)), "roots")
    me = F.struct("is_null", "id", "tag")  # rows without an id come last
    named = kept.groupBy("node").agg(F.min(me).alias("least")).join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("first"))
    named = named.join(least, "root").select(F.col("node").alias("c_node"), F.col("first").alias("class"))
    named = saved(named, "classes")  # one row a set: Spark can split a text with very many copies on the other side of the join
    out = found.select("id", "tag", "is_null", "n_shingles", "node").join(named, F.col("node") == F.col("c_node"), "left").withColumn("class", F.coalesce("class", me))
    if names:
        return out.select("id", "tag", (F.col("class") == me).alias("stays"))
    return out.select(F.when(~F.col("is_null"), F.col("id")).alias(id_col), "n_shingles", F.when(~F.col("class.is_null"), F.col("class.id")).alias("component_id"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple[int | None, str | None]], n: int = GRAM, num: int = NUM, den: int = DEN) -> list[tuple[int | None, int, int | None]]:
    """The same by comparing all pairs of word sets; for tests."""
    import re

    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parts, where = linking.Sets(len(rows)), {}
    for k, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    pairs = {(a, b) for v in where.values() for a in v for b in v if a < b}
    for a, b in pairs:
        if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            parts.union(a, b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        r = parts.find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, len(sets[k]), least.get(parts.find(k))) for k, (i, _) in enumerate(rows)]
