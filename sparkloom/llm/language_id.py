"""Operator 8: language identification by rank-order profiles.

A profile is the ``PROFILE`` most frequent character 1- to 3-grams of a language's texts, in
order of frequency. A document's own most frequent grams are compared to every profile by
out-of-place distance: the sum, over the document's grams, of the difference between the gram's
rank in the document and in the profile, or PROFILE where the profile lacks it. The nearest
language wins; the score is the runner-up's part of the two distances (1 with one language).

Grams are taken from lower-cased letters, with a blank at the ends of each run of letters.
Profiles are learned from ``SAMPLE`` different rows of each language at most, among those that are not
held out (crc32 of the id as text, mod 4, is not 2), chosen by a hash of id and text: a language
with few rows is learned from all of them. Predictions use the whole text and nothing but the text.

Defined cases: null texts and those without a letter are ``und`` with score 0, as are all texts
when nothing could be learned; equal distances go to the first language in order; equal counts
are ranked by a fixed hash of the gram; a row without an id is held out; repeated rows come
back as often; other columns are not looked at.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel
from .common import few, ship, table

PROFILE, SAMPLE, GRAMS = 300, 2000, 3
#: Grams are named by this many bits of a hash: a text's index, its counts and its grams then share one 64-bit number.
BITS = 40
SPREAD = 1 << 50
_letters: list[np.ndarray] = []


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sampled(rows: DataFrame, by: str, most: int) -> DataFrame:
    """At most ``most`` rows of each value of ``by``, of different hashes ``h``: those of the least hashes.

    Rows are first held against a bound that lets about twice as many pass, so that few are ranked.
    """
    counts = rows.groupBy(by).agg(F.approx_count_distinct("h").alias("n")).select(F.col(by).alias("c_by"), F.least(F.lit(1.0), 2.5 * most / F.col("n")).alias("share"))
    near = rows.join(F.broadcast(counts) if few(counts) else counts, F.col(by) == F.col("c_by")).where(F.pmod("h", F.lit(SPREAD)) <= F.col("share") * SPREAD)
    near = near.drop("c_by", "share").dropDuplicates([by, "h"])
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.pmod("h", F.lit(SPREAD)), "h"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def is_letter(points: np.ndarray) -> np.ndarray:
    """Unicode letters among code points."""
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x20000)), bool, 0x20000))
    known = points < 0x20000
    out = np.zeros(len(points), bool)
    out[known] = _letters[0][points[known]]
    for c in np.unique(points[~known]):
        out[points == c] = unicodedata.category(chr(c))[0] == "L"
    return out


def grams(texts: kernel.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, count) of all texts of a slice, in order of text; gram is a hash of BITS bits."""
    parts = [texts.bytes_of(k).decode("utf-8", "replace").lower().encode("utf-32-le", "replace") for k in range(texts.n)]
    points = np.frombuffer(b"\0\0\0\0".join([b"", *parts, b""]), np.uint32)
    sizes = np.fromiter((len(p) // 4 for p in parts), np.int64, texts.n)
    owner = np.repeat(np.arange(texts.n + 1), np.append(1 + sizes, 1))  # each text behind its marker
    points = np.where(is_letter(points), points, 0)
    keep = (points != 0) | np.append(True, points[:-1] != 0)  # one blank between runs of letters
    points, owner = points[keep].astype(np.uint64), owner[keep]
    found, code = [], points
    for n in range(1, GRAMS + 1):
        if n > 1:
            code = (code[:-1] << np.uint64(21)) | points[n - 1 :]
        # a run's blanks come from the text's marker or the next one's: a gram belongs to the text of its letters
        if n == 1:
            ok, of = points != 0, owner
        elif n == 2:
            left, right = points[:-1] != 0, points[1:] != 0
            ok, of = left | right, np.where(left, owner[:-1], owner[1:])
        else:
            ok, of = points[1:-1] != 0, owner[1:-1]
        hashed = kernel.mix(code[ok] * np.uint64(4) + np.uint64(n)) >> np.uint64(64 - BITS)
        found.append((of[ok].astype(np.uint64) << np.uint64(BITS)) | hashed)
    every = np.sort(np.concatenate(found))
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
    count = np.diff(np.append(first, len(every)))
    every = every[first]
    return (every >> np.uint64(BITS)).astype(np.int64), every & np.uint64((1 << BITS) - 1), count


def top(text: np.ndarray, gram: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, rank from 0) of each text's most frequent grams."""
    order = np.lexsort((gram, -count, text))
    text, gram = text[order], gram[order]
    start = np.searchsorted(text, text)
    rank = np.arange(len(text)) - start
    return text[rank < most], gram[rank < most], rank[rank < most]


def learn(docs: DataFrame, sample: int = SAMPLE, profile: int = PROFILE) -> dict[str, dict[int, int]]:
    """language -> gram -> rank, from rows with a language that are not held out."""
    ship(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    rows = sampled(rows, "lang", sample).select("lang", "text")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[int, int]] = {}
        for batch, texts in kernel.slices(batches):
            text, gram, count = grams(texts)
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs):
                own = langs[text] == lang
                total = sums.setdefault(lang, {})
                which, at = np.unique(gram[own], return_inverse=True)
                for g, c in zip(which.tolist(), np.bincount(at, count[own]).astype(int).tolist(), strict=True):
                    total[g] = total.get(g, 0) + c
        for lang, total in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(total), "gram": list(total), "n": list(total.values())}, pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]))

    sums = rows.mapInArrow(counts, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1).where(F.col("rank") < profile)
    out: dict[str, dict[int, int]] = {}
    for r in ranked.collect():  # PROFILE rows a language
        out.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    return dict(sorted(out.items()))


def predict(docs: DataFrame, profiles: dict[str, dict[int, int]], keep: tuple[str, ...] = ("doc_id",), most: int = PROFILE) -> DataFrame:
    """Every row with lang_pred and score."""
    ship(docs.sparkSession)
    langs = list(profiles)
    known = np.array(sorted({g for p in profiles.values() for g in p}), np.uint64)
    ranks = np.full((len(langs), len(known) + 1), most, np.int64)
    for k, p in enumerate(profiles.values()):
        ranks[k, : len(known)] = [p.get(int(g), most) for g in known]
    schema = docs.select(*keep).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in kernel.slices(batches):
            text, gram, rank = top(*grams(texts), most)
            at = np.searchsorted(known, gram)
            at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != gram) if len(known) else slice(None)] = len(known)
            far = np.zeros((len(langs), texts.n))
            for k in range(len(langs)):
                gap = np.where(ranks[k][at] == most, most, np.abs(ranks[k][at] - rank))
                far[k] = np.bincount(text, gap, texts.n)
            seen = np.bincount(text, minlength=texts.n) > 0
            if langs:
                best = far.argmin(axis=0)
                near = far.min(axis=0)
                second = np.partition(far, 1, axis=0)[1] if len(langs) > 1 else near
                score = np.where(seen, second / np.maximum(near + second, 1e-9), 0.0) if len(langs) > 1 else np.where(seen, 1.0, 0.0)
                pred = [langs[b] if s else "und" for b, s in zip(best, seen, strict=True)]
            else:
                score, pred = np.zeros(texts.n), ["und"] * texts.n
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(pred, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    out = schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, "text").mapInArrow(judge, out)


def brute_force(rows: list[tuple[str | None, str | None, bool]], sample: int = SAMPLE, profile: int = PROFILE) -> list[tuple[str, float]]:
    """(lang_pred, score) of rows (text, lang, learns), by dictionaries of grams; for tests with fewer rows than ``sample``."""
    from collections import Counter

    def named(gram: str) -> int:
        code = 0
        for c in gram:
            code = (code << 21 | (0 if c == " " else ord(c))) & (1 << 64) - 1
        return int(kernel.mix(np.array([code], np.uint64) * np.uint64(4) + np.uint64(len(gram)))[0]) >> 64 - BITS

    def bag(text: str) -> Counter:
        runs = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split()
        line = " " + " ".join(runs) + " "
        return Counter(g for n in range(1, GRAMS + 1) for i in range(len(line) - n + 1) for g in [line[i : i + n]] if (g.strip() if n < 3 else g[1] != " "))

    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], named(x[0])))][:profile]
    sums: dict[str, Counter] = {}
    for text, lang in [(t, g) for t, g, learns in rows if learns and t is not None and g is not None]:
        sums.setdefault(lang, Counter()).update(bag(text))
    ranks = {g: {x: k for k, x in enumerate(order(c))} for g, c in sorted(sums.items()) if c}
    out = []
    for text, _, _ in rows:
        own = order(bag(text or ""))
        far = sorted((sum(abs(p[g] - k) if g in p else profile for k, g in enumerate(own)), n) for n, p in ranks.items())
        out.append(("und", 0.0) if not own or not far else (far[0][1], far[1][0] / max(far[0][0] + far[1][0], 1e-9) if len(far) > 1 else 1.0))
    return out


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
