"""Operator 7: removal of repeated token windows.

Every window of ``WINDOW`` consecutive words of one document is hashed (Rabin-Karp over word
hashes, modulo 2^64, mixed). The hashes go, packed as 7-byte keys with one-byte place steps, to
buckets by their highest bits; there equal keys are counted, the first occurrence by (doc_id,
place) stays and the places of all others go back to their documents, where overlapping windows
merge into maximal intervals whose words are removed. Windows are judged on the input alone.

A key is 64 bits wide once there are 256 buckets (56 bits and the bucket's number below): among n
windows about n^2 / 2^65 pairs collide by chance, under one in a thousand runs over 10^8 windows.
Texts of one id are told apart by a hash of 64 bits too.

A hot window costs no more than others: it is a key in one bucket, whose occurrences are sorted
as bytes, not grouped as rows; the number of buckets follows the bytes of text.

Defined cases: a null or empty text has no words, its kept text is empty; rows that repeat both
doc_id and text are one document and each comes back; rows that share only a doc_id are
ordered by a hash of their text; a null doc_id comes before all others; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import release, saved, ship, table

WINDOW = 20
#: Bytes of text whose windows fall into one bucket: about two and a half million windows.
BUCKET_BYTES = 16_000_000
FIRST_ID = -(1 << 63)

KEPT = pa.schema([("id", pa.int64()), ("is_null", pa.bool_()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def keyed(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, tag, is_null, text): id without nulls; tag, 64 bits of a hash, tells texts of one id apart."""
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(FIRST_ID)).alias("id"), F.xxhash64("text").alias("tag"), F.col(id_col).isNull().alias("is_null"), "text")


def bucket_count(docs: DataFrame, each: int, text: str = "text") -> int:
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def _runs(places: np.ndarray) -> np.ndarray:
    places = np.sort(places)
    brk = np.flatnonzero(np.diff(places) > 1)
    return np.column_stack([places[np.append(0, brk + 1)], places[np.append(brk, len(places) - 1)]]).ravel()


def repeated_places(rows: DataFrame, window: int, buckets: int) -> DataFrame:
    """(id, tag, places): first and last place, as packed int32 pairs, of each run of windows that are not the first of their kind."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in kernel.slices(batches):
            w = kernel.words(texts)
            keys, text = kernel.windows(w.hash, window), w.text_of()
            whole = np.flatnonzero(text[: len(keys)] == text[len(text) - len(keys) :])
            ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
            found = list(kernel.pack(ids, tags, text[whole], keys[whole], whole - w.at[text[whole]], buckets))
            if found:
                yield kernel.to_batch(found, kernel.PACKED_ARROW)

    def judge(rows: pa.Table) -> pa.Table:
        packed = kernel.unpack(rows)
        own = kernel.repeated(packed.keys)
        keys, place = packed.keys[own], packed.place[own]
        ids, tags = packed.owners(own)
        del packed
        order = np.lexsort((place, tags, ids, keys))
        keys, place, ids, tags = keys[order], place[order], ids[order], tags[order]
        new = np.diff(keys, prepend=~keys[:1]) != 0
        # rows that repeat id and text are one document: the same place again is no repetition
        twice = ~new & np.append(False, (ids[1:] == ids[:-1]) & (tags[1:] == tags[:-1]) & (place[1:] == place[:-1]))[: len(keys)]
        head = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
        as_head = (ids == ids[head]) & (tags == tags[head]) & (place == place[head]) if len(keys) else new
        gone = ~new & ~twice & ~as_head
        out = kernel.reply(ids[gone], tags[gone], place[gone].astype(np.int32), None, buckets)
        pa.default_memory_pool().release_unused()
        return out

    packed = rows.select("id", "tag", "text").mapInArrow(emit, kernel.PACKED)
    found = packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(judge, kernel.REPLY)
    found = found.repartition(buckets, "dest").groupBy("dest").applyInArrow(kernel.gather("int32", squeeze=_runs), kernel.GATHERED)
    return found.select("id", "tag", F.col("a").alias("places"))


def cut_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_words, n_removed and ``kept``, the words left joined by one space."""
    ship(docs.sparkSession)
    rows = keyed(docs, id_col)
    places = saved(repeated_places(rows, window, bucket_count(docs, BUCKET_BYTES)), "repeats")
    release(docs.sparkSession)  # the keys' shuffle files

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in kernel.slices(batches):
            out: list[str] = []
            n_words, n_removed = np.zeros(texts.n, np.int64), np.zeros(texts.n, np.int64)
            for k, found in enumerate(batch.column("places").to_pylist()):
                parts = texts.bytes_of(k).split()
                n_words[k] = len(parts)
                if found:
                    runs = np.frombuffer(found, np.int32).reshape(-1, 2)
                    depth = np.zeros(len(parts) + 1, np.int64)
                    np.add.at(depth, runs[:, 0], 1)
                    np.add.at(depth, runs[:, 1] + window, -1)
                    stay = np.flatnonzero(np.cumsum(depth)[:-1] == 0)
                    n_removed[k] = len(parts) - len(stay)
                    parts = [parts[i] for i in stay]
                out.append(b" ".join(parts).decode())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("is_null"), pa.array(n_words), pa.array(n_removed), pa.array(out, pa.string())], schema=KEPT)

    joined = rows.join(places.withColumnsRenamed({"id": "p_id", "tag": "p_tag"}), (F.col("id") == F.col("p_id")) & (F.col("tag") == F.col("p_tag")), "left")
    rows = joined.select("id", "is_null", "text", "places").mapInArrow(kept, "id bigint, is_null boolean, n_words bigint, n_removed bigint, kept string")
    return rows.select(F.when(~F.col("is_null"), F.col("id")).alias(id_col), "n_words", "n_removed", "kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """The same by dictionaries of whole windows; for tests."""
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    first: dict[tuple, tuple] = {}
    for i, w in docs:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, (i, p)), (i, p))
    out = []
    for i, w in docs:
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < (i, p) for q in range(p, p + window)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
