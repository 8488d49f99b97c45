"""Vectorised words, hashes and packed occurrences over Arrow batches of texts.

Everything works on the UTF-8 bytes of many texts at once. A word's hash is taken from prefix
sums of byte x BASE^place modulo 2^64 and then mixed, so no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Texts are worked on in slices of about this many bytes (a longer text is a slice of its own) and at most so many texts.
SLICE_BYTES, SLICE_ROWS = 1_000_000, 1000
SPACES = b" \t\n\x0b\x0c\r"
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0.. and its inverses modulo 2^64, at least n + 1 of each."""
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Spans:
    """Hashes of any byte ranges of a buffer."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


@dataclass
class Texts:
    """Texts of one slice: their bytes and where each starts."""

    data: np.ndarray
    at: np.ndarray

    @property
    def n(self) -> int:
        return len(self.at) - 1

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.at[k] : self.at[k + 1]].tobytes()


@dataclass
class Words:
    """Words of a slice: byte ranges, and the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    hash: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Batches cut into slices; null texts count as empty."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_string()).fill_null("")
        raw, body = texts.buffers()[1], texts.buffers()[2]
        at = np.frombuffer(raw, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        k = 0
        while k < len(texts):
            to = min(max(k + 1, int(np.searchsorted(at, at[k] + SLICE_BYTES, "right")) - 1), k + SLICE_ROWS)
            yield batch.slice(k, to - k), Texts(data[at[k] : at[to]], at[k : to + 1] - at[k])
            k = to


def characters(texts: Texts) -> Texts:
    """The same texts as code points. Texts of a slice that is not valid UTF-8 stay bytes."""
    try:
        points = np.frombuffer(texts.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        return Texts(texts.data.astype(np.uint32), texts.at)
    if len(points) == len(texts.data):
        return Texts(points, texts.at)
    size = np.diff(texts.at)
    some = np.flatnonzero(size)
    first = (texts.data & 0xC0) != 0x80
    size[some] = np.add.reduceat(first, texts.at[:-1][some], dtype=np.int64)
    return Texts(points, np.append(0, np.cumsum(size)))


def words(texts: Texts) -> Words:
    """Runs of bytes other than white space; hashes as ``Spans`` gives them."""
    inside = np.ones(256, bool)
    inside[list(SPACES)] = False
    on = inside[texts.data]
    first, last = on.copy(), on.copy()
    if len(on):
        first[1:] &= ~on[:-1]
        last[:-1] &= ~on[1:]
        edges = texts.at[:-1][np.diff(texts.at) > 0]
        first[edges] = on[edges]
        ends = texts.at[1:][np.diff(texts.at) > 0] - 1
        last[ends] = on[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(start, end, np.searchsorted(start, texts.at), Spans(texts.data).hashes(start, end))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash of every run of n hashes (over text ends too), by doubling."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    part, have, out, done = hashes, 1, None, 0
    while True:
        if n & have:
            size = len(hashes) - done - have + 1
            out = part[:size] if out is None else out[:size] * U64(pow(BASE, have, 1 << 64)) + part[done : done + size]
            done += have
        if done == n:
            return mix(out)
        part = part[: len(part) - have] * U64(pow(BASE, have, 1 << 64)) + part[have:]
        have *= 2


#: One row: the occurrences of one slice that fall into one bucket. ids, tags, counts: a text each; keys: an occurrence each, KEY_BYTES of its eight bytes
#: (the highest is told by the bucket, all but a few of its bits); steps: places as steps within a text.
KEY_BYTES = 7
PACKED = "bucket int, ids binary, tags binary, counts binary, keys binary, steps binary, long_steps binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), *[(x, pa.binary()) for x in ("ids", "tags", "counts", "keys", "steps", "long_steps")]])


def pack(ids: np.ndarray, tags: np.ndarray, text: np.ndarray, keys: np.ndarray, place: np.ndarray | None, buckets: int) -> Iterator[dict]:
    """Occurrences, in order of (text, place), dealt into buckets by key. ids and tags name the texts."""
    bucket = (((keys >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.uint32)  # by the highest bits
    order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[b] : cuts[b + 1]]
        t = text[own]
        new = np.flatnonzero(np.diff(t, prepend=-1))
        row = {"bucket": int(b), "ids": ids[t[new]].tobytes(), "tags": tags[t[new]].tobytes(), "counts": np.diff(np.append(new, len(t))).astype(np.uint32).tobytes(), "keys": np.ascontiguousarray(keys[own]).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes(), "steps": b"", "long_steps": b""}
        if place is not None:
            p = place[own].astype(np.int64)
            step = np.diff(p, prepend=0)
            step[new] = p[new]
            row |= {"steps": np.minimum(step, 255).astype(np.uint8).tobytes(), "long_steps": step[step >= 255].astype(np.uint32).tobytes()}
        yield row


@dataclass
class Packed:
    """Occurrences of a bucket: keys and places of each, id and tag of each run of ``counts`` of them."""

    ids: np.ndarray
    tags: np.ndarray
    ends: np.ndarray
    keys: np.ndarray
    place: np.ndarray

    def owners(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, tag) of some occurrences; they are not spread over all."""
        of = np.searchsorted(self.ends, which, "right")
        return self.ids[of], self.tags[of]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Indices of keys that occur more than once, in order of key."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    return order[np.append(same, False) | np.append(False, same)]


def unpack(rows: pa.Table) -> Packed:
    get = lambda name, kind: np.frombuffer(b"".join(x.as_buffer() for c in rows.column(name).chunks for x in c), kind)
    counts = get("counts", np.uint32)
    steps = get("steps", np.uint8)
    if len(steps):
        first = np.cumsum(counts, dtype=np.int64) - counts
        place = steps.astype(np.int64)
        place[steps == 255] = get("long_steps", np.uint32)
        base = place[first]
        np.cumsum(place, out=place)
        place -= np.repeat(place[first] - base, counts)
    else:
        place = np.zeros(0, np.int64)
    short = get("keys", np.uint8).reshape(-1, KEY_BYTES)
    keys = np.zeros((len(short), 8), np.uint8)
    keys[:, :KEY_BYTES] = short
    return Packed(get("ids", np.int64), get("tags", np.int64), np.cumsum(counts, dtype=np.int64), keys.view(U64).ravel(), place)


#: What buckets send back to texts: one row a bucket and destination. a and b: values of each entry.
REPLY = "dest int, ids binary, tags binary, counts binary, a binary, b binary"
REPLY_ARROW = pa.schema([("dest", pa.int32()), *[(x, pa.binary()) for x in ("ids", "tags", "counts", "a", "b")]])
GATHERED = "id bigint, tag bigint, a binary, b binary"
GATHERED_ARROW = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


def _cuts(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Where runs of equal (id, tag) begin, and the end."""
    new = np.append(True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))[: len(ids)]
    return np.append(np.flatnonzero(new), len(ids))


def reply(ids: np.ndarray, tags: np.ndarray, a: np.ndarray, b: np.ndarray | None, dests: int) -> pa.Table:
    """Entries packed by the texts' destination, so that rows follow buckets and destinations and not texts."""
    dest = (mix(ids.view(U64)) % U64(dests)).astype(np.int64)
    order = np.lexsort((tags, ids, dest))
    ids, tags, a, dest = ids[order], tags[order], a[order], dest[order]
    b = b[order] if b is not None else None
    ends = np.searchsorted(dest, np.arange(dests + 1))
    rows = []
    for d in np.flatnonzero(np.diff(ends)):
        lo, hi = ends[d], ends[d + 1]
        cut = _cuts(ids[lo:hi], tags[lo:hi])
        rows.append({"dest": int(d), "ids": ids[lo:hi][cut[:-1]].tobytes(), "tags": tags[lo:hi][cut[:-1]].tobytes(), "counts": np.diff(cut).astype(np.uint32).tobytes(), "a": _small(a[lo:hi]), "b": _small(b[lo:hi]) if b is not None else b""})
    return pa.Table.from_pylist(rows, schema=REPLY_ARROW)


def _small(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def gather(a_kind: str, b_kind: str | None = None, squeeze: Callable[[np.ndarray], np.ndarray] | None = None) -> Callable[[pa.Table], pa.Table]:
    """For groups of replies by dest: one row a text with all its values; ``squeeze`` may shorten a text's a."""

    def merge(rows: pa.Table) -> pa.Table:
        get = lambda name, kind: np.frombuffer(b"".join(x.as_py() for c in rows.column(name).chunks for x in c), kind)
        counts = get("counts", np.uint32)
        ids, tags = np.repeat(get("ids", np.int64), counts), np.repeat(get("tags", np.int64), counts)
        sizes = [len(x.as_py()) // 4 for c in rows.column("counts").chunks for x in c]
        sizes = [int(n.sum()) for n in np.split(counts, np.cumsum(sizes)[:-1])]

        def values(name: str, kind: str) -> np.ndarray:
            packed = (x.as_py() for c in rows.column(name).chunks for x in c)
            return np.frombuffer(b"".join(pa.decompress(x, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True) for x, n in zip(packed, sizes, strict=True)), kind)

        a, b = values("a", a_kind), values("b", b_kind) if b_kind else None
        order = np.lexsort((tags, ids))
        ids, tags, a = ids[order], tags[order], a[order]
        cut = _cuts(ids, tags)
        parts = lambda x, f=None: pa.array([(f(x[i:j]) if f else x[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
        return pa.table([pa.array(ids[cut[:-1]]), pa.array(tags[cut[:-1]]), parts(a, squeeze), parts(b[order]) if b is not None else pa.nulls(len(cut) - 1, pa.binary())], schema=GATHERED_ARROW)

    return merge


def to_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)
