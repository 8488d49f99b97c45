"""Operator 10: quality by nearest-neighbour voting in a latent-semantic space.

A text becomes three bags of hashed features: byte trigrams, word shapes (runs of small letters,
capitals, digits, bytes beyond ASCII and each punctuation mark, one sign a run) and habits
(words equal to the one before, words seen before, length by powers of two). Each bag is
weighted log(1 + tf) x idf, with document frequencies counted over all documents, and scaled to
length 1; a truncated singular value decomposition of the labelled sample gives ``RANK`` latent
dimensions. The labelled vectors are broadcast, and every document is compared to all of them by
blocked cosine products; the ``NEIGHBOURS`` nearest vote with weights similarity^4.

The sample has ``SAMPLE`` ids of either label at most, none held out (crc32 of the id as text, mod 4,
is not 2), those of the least hashes; of texts that share an id the one with the least hash is
taken. Each side counts by its share in all labelled rows.

Defined cases: a null or empty text is scored from its length feature like any other; without
labelled rows every score is 0.5; several labels of one id that differ count once each; a row
without an id is held out; repeated rows come back as often; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import ship, table
from .language_id import held_out, sampled

SAMPLE, RANK, NEIGHBOURS, THRESHOLD = 800, 64, 25, 0.7
#: Width of the three bags.
BAGS = (1024, 512, 64)
WIDTH = sum(BAGS)


def _classes() -> np.ndarray:
    kind = np.arange(256, dtype=np.uint8)
    kind[ord("a") : ord("z") + 1] = ord("a")
    kind[ord("A") : ord("Z") + 1] = ord("A")
    kind[ord("0") : ord("9") + 1] = ord("0")
    kind[128:] = 128
    kind[list(kernel.SPACES)] = 32
    return kind


def features(texts: kernel.Texts) -> np.ndarray:
    """Counts, texts x WIDTH."""
    n, wide = texts.n, BAGS[0]
    out = np.zeros((n, WIDTH), np.float32)
    data = texts.data.astype(np.uint32)
    if len(data) >= 3:
        of = np.repeat(np.arange(n), np.diff(texts.at))
        code = (data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(22)
        own = of[:-2] == of[2:]
        out[:, :wide] = np.bincount(of[:-2][own] * wide + code[own], minlength=n * wide).reshape(n, wide)
    kind = _classes()[texts.data]
    new = np.append(True, kind[1:] != kind[:-1])[: len(kind)]
    edge = texts.at[:-1][np.diff(texts.at) > 0]
    new[edge] = True
    before = np.append(0, np.cumsum(new))
    shapes = kernel.words(kernel.Texts(kind[new], before[texts.at]))
    key = (shapes.hash >> np.uint64(20)) % np.uint64(BAGS[1])
    out[:, wide : wide + BAGS[1]] = np.bincount(shapes.text_of() * BAGS[1] + key.astype(np.int64), minlength=n * BAGS[1]).reshape(n, -1)
    w = kernel.words(texts)
    of, total = w.text_of(), np.diff(w.at)
    again = np.append(False, (w.hash[1:] == w.hash[:-1]) & (of[1:] == of[:-1]))[: len(of)]
    keyed = np.sort(kernel.mix(w.hash ^ (of.astype(np.uint64) * np.uint64(kernel.BASE))) >> np.uint64(20) | of.astype(np.uint64) << np.uint64(44))
    distinct = np.bincount((keyed[np.append(True, keyed[1:] != keyed[:-1])[: len(keyed)]] >> np.uint64(44)).astype(np.int64), minlength=n)
    habits = out[:, wide + BAGS[1] :]
    habits[np.arange(n), np.ceil(np.log2(1 + total)).astype(int).clip(0, 20)] = 1
    share = lambda x: np.floor(10 * x / np.maximum(total, 1)).astype(int)
    habits[np.arange(n), 21 + share(np.bincount(of, again, n))] = 4
    habits[np.arange(n), 33 + share(total - distinct)] = 1
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    at = 0
    for wide in BAGS:
        bag = x[:, at : at + wide]
        bag /= np.maximum(np.linalg.norm(bag, axis=1, keepdims=True), 1e-9)
        at += wide
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((1 + documents) / (1 + document frequency)) + 1 of every feature, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WIDTH + 1, np.int64)
        for _, texts in kernel.slices(batches):
            total[:WIDTH] += (features(texts) > 0).sum(axis=0)
            total[WIDTH] += texts.n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH + 1)), pa.array(total)], names=["k", "n"])

    sums = {r["k"]: r["n"] for r in docs.select("text").mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    df = np.array([sums.get(k, 0) for k in range(WIDTH + 1)], float)
    return (np.log((1 + df[WIDTH]) / (1 + df[:WIDTH])) + 1).astype(np.float32)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK) -> dict:
    """What ``score`` needs: idf, projection, labelled vectors, their labels and weights."""
    spark = docs.sparkSession
    ship(spark)
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    counts = {r["quality"]: r["count"] for r in own.groupBy("quality").count().collect()}
    own = sampled(own.withColumn("h", F.xxhash64("doc_id")), "quality", sample).drop("h")  # 2 x sample rows at most
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in kernel.slices(batches):
            x = features(texts).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([v.tobytes() for v in x], pa.binary())], names=["doc_id", "quality", "x"])

    found = rows.mapInArrow(vectors, "doc_id bigint, quality int, x binary").orderBy("doc_id", "quality").collect()
    idf = inverse_frequencies(docs)
    if not found:
        return {"idf": idf, "to": np.zeros((WIDTH, 1), np.float32), "near": np.zeros((0, 1), np.float32), "label": np.zeros(0), "weight": np.zeros(0)}
    x = weigh(np.stack([np.frombuffer(r["x"], np.float32) for r in found]), idf)
    values, basis = np.linalg.eigh(x.T.astype(float) @ x)
    to = basis[:, np.argsort(-values)[:rank]].astype(np.float32)
    label = np.array([r["quality"] for r in found], float)
    weight = np.where(label == 1, counts.get(1, 0) / max(label.sum(), 1), counts.get(0, 0) / max((1 - label).sum(), 1))
    return {"idf": idf, "to": to, "near": unit(x @ to), "label": label, "weight": weight / weight.mean()}


def score(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), neighbours: int = NEIGHBOURS, name: str = "score") -> DataFrame:
    """Every row with its score, in a column called ``name``."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by sample x rank and WIDTH x rank
    out = docs.select(*keep).schema.add(name, "double")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch, texts in kernel.slices(batches):
            found = np.full(texts.n, 0.5)
            if len(m["near"]):
                x = unit(weigh(features(texts), m["idf"]) @ m["to"])
                near = x @ m["near"].T
                k = min(neighbours, near.shape[1])
                best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                vote = np.maximum(np.take_along_axis(near, best, axis=1), 1e-3).astype(float) ** 4 * m["weight"][best]
                found = (vote * m["label"][best]).sum(axis=1) / vote.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(np.clip(found, 0.0, 1.0))], names=[*keep, name])

    columns = dict.fromkeys([*keep, "text"])
    return docs.select(*columns).mapInArrow(judge, out)


def plain_features(text: str | None) -> np.ndarray:
    """What ``features`` gives for one text, byte by byte and word by word; for tests."""
    data, out = (text or "").encode(), np.zeros(WIDTH, np.float32)
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        out[((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & 0xFFFFFFFF) >> 22] += 1
    kind = bytes(_classes()[b] for b in data)
    shape = bytes(b for k, b in enumerate(kind) if not k or kind[k - 1] != b)
    for run in (x for x in shape.split(b" ") if x):
        raw = np.frombuffer(run, np.uint8)
        out[BAGS[0] + (int(kernel.Spans(raw).hashes(np.array([0]), np.array([len(raw)]))[0]) >> 20) % BAGS[1]] += 1
    words = data.split()
    n, habits = len(words), out[BAGS[0] + BAGS[1] :]
    habits[min(int(np.ceil(np.log2(1 + n))), 20)] = 1
    habits[21 + (10 * sum(a == b for a, b in zip(words, words[1:], strict=False))) // max(n, 1)] = 4
    habits[33 + (10 * (n - len(set(words)))) // max(n, 1)] = 1
    return out


def brute_force(texts: list[str | None], labelled: list[tuple[str | None, int]], rank: int = RANK, neighbours: int = NEIGHBOURS) -> list[float]:
    """Scores of ``texts`` from ``labelled`` (text, label) by single vectors and sorted votes; for tests with fewer labels than ``SAMPLE``."""
    every = [plain_features(t) for t in texts]
    idf = np.array([np.log((1 + len(texts)) / (1 + sum(x[k] > 0 for x in every))) + 1 for k in range(WIDTH)])

    def weighed(counts: np.ndarray) -> np.ndarray:
        bags = np.split(np.log(1 + counts.astype(float)) * idf, np.cumsum(BAGS)[:-1])
        return np.concatenate([b / max(np.sqrt((b * b).sum()), 1e-9) for b in bags])

    known = np.stack([weighed(plain_features(t)) for t, _ in labelled])
    to = np.linalg.svd(known, full_matrices=False)[2][:rank]
    place = lambda x: (to @ x) / max(np.sqrt(((to @ x) ** 2).sum()), 1e-9)
    near = [place(x) for x in known]
    out = []
    for x in every:
        mine = place(weighed(x))
        votes = sorted(((max(float(mine @ v), 1e-3), label) for v, (_, label) in zip(near, labelled, strict=True)), reverse=True)[:neighbours]
        out.append(sum(s**4 for s, label in votes if label) / sum(s**4 for s, _ in votes))
    return out


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs.select("doc_id", "text"), learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
