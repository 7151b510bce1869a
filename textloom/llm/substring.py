"""Substring dedup with difference-cover anchors.

The cover {0, 1, 3, 8, 12, 18} modulo 31 has every difference: whatever two positions a passage of 50 words starts at,
one of its first 31 words stands at a cover position in both places. So only windows of 20 words that start at cover
positions are hashed (a fifth of all); a repeated passage shares at least one, whose first word is among its own first 31.

1. Anchors: (hash, document) at cover positions; those of a single document go, by a grouping with map-side combine.
2. Extension: in documents with a repeated anchor, the windows of 50 words that hold one are hashed in full.
3. Judgement: a window goes if the smallest document with its hash is smaller than its own; again a grouping and an
   equi-join, so documents that share a passage are never paired with each other, and a hot passage is pre-aggregated
   and its join can be split.
4. Removal: the ranges of each document are applied to its text.

Steps 2 and 4 bring ranges to the texts. Where the ranges of all documents are within `broadcast_bytes` they are
sent to the workers and texts are only scanned; beyond that they are joined by doc_id.

A row is known by its doc_id and a hash of its text, so ranges found in one row never touch another row of that doc_id.

Definitions: a null or empty text has no words; a null doc_id is the smallest document; rows that share a doc_id are
judged each by its own windows, against documents with a smaller doc_id. An empty table gives an empty result, further
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, materialize, raw

WINDOW = 50
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
BROADCAST_BYTES = 64 << 20
LOWEST = -(1 << 63)
CACHE = 1 << 18
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)


class Hashes(dict):
    """Word to 64-bit hash, for the words met last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Rolling:
    """Hashes of windows of word hashes modulo 2^64, by prefix sums."""

    def __init__(self) -> None:
        self.known, self.up, self.down = Hashes(), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(n - 1, BASE, np.uint64))))
            self.down = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(n - 1, INVERSE, np.uint64))))

    def prefix(self, words: list[bytes]) -> np.ndarray:
        n = len(words)
        self.powers(n + 1)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, n)
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * self.up[:n])))

    def windows(self, prefix: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the windows of `size` words that start at `at`, signed."""
        x = (prefix[at + size] - prefix[at]) * self.down[at]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))).view(np.int64)


def cover_positions(n: int) -> np.ndarray:
    """Positions below n that the cover has."""
    if n <= 0:
        return np.zeros(0, np.int64)
    at = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)[None, :]).ravel()
    return at[at < n]


def ranges_of(at: np.ndarray, before: int, after: int) -> np.ndarray:
    """Merged ranges [x - before, x + after) of sorted positions x, as (k, 2)."""
    begin, end = np.maximum(at - before, 0), at + after
    split = np.flatnonzero(begin[1:] > end[:-1]) + 1
    return np.stack([begin[np.concatenate(([0], split))], end[np.concatenate((split - 1, [len(at) - 1]))]], 1)


WINDOWS = "h bigint, doc bigint, th bigint, pos int"


class Collected:
    """Window hashes of rows (doc, th), gathered to a batch of WINDOWS."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, h: np.ndarray, doc: int, th: int, at: np.ndarray) -> None:
        self.parts.append((h, np.full(len(at), doc, np.int64), np.full(len(at), th, np.int64), at.astype(np.int32)))

    def batch(self) -> pa.RecordBatch:
        none = [np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int32)]
        return batch(["h", "doc", "th", "pos"], [pa.array(np.concatenate(x)) for x in zip(none, *self.parts, strict=True)])


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """(h, doc, th, pos): the hashed windows at cover positions of docs (doc, th, text)."""
    size = window - PERIOD + 1

    def factory():
        roll = Rolling()

        def step(b: pa.RecordBatch):
            out = Collected()
            for doc, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2)), strict=True):
                words = text.split()
                if len(words) >= window:
                    at = cover_positions(len(words) - size + 1)
                    out.add(roll.windows(roll.prefix(words), at, size), doc, th, at)
            yield out.batch()

        return step

    return arrow_map(docs, WINDOWS, factory, rows=200)


def shared(rows: DataFrame) -> DataFrame:
    """(h, least): hashes of rows (h, doc) that more than one document has, and the smallest."""
    return rows.groupBy("h").agg(F.min("doc").alias("least"), F.max("doc").alias("largest")).where("least < largest").select("h", "least")


def packed_ranges(rows: DataFrame, before: int, after: int) -> DataFrame:
    """(doc, th, ranges): the merged ranges around the positions of rows (doc, th, pos), packed as 32-bit pairs.

    A row's positions are a set, so repeated rows are reduced before they meet."""

    def factory():
        def step(b: pa.RecordBatch):
            at = b.column(2)
            values, ends = at.values.to_numpy().astype(np.int64), at.offsets.to_numpy()
            out = [ranges_of(np.unique(values[x:y]), before, after).astype("<i4").tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield batch(["doc", "th", "ranges"], [b.column(0), b.column(1), pa.array(out, pa.binary())])

        return step

    return arrow_map(rows.groupBy("doc", "th").agg(F.collect_set("pos").alias("at")), "doc bigint, th bigint, ranges binary", factory)


def with_ranges(docs: DataFrame, ranges: DataFrame, broadcast_bytes: int, inner: bool):
    """docs (doc, th, text, ...) with the packed ranges of each row: a frame and a function from a batch to its ranges.

    ranges is a written table. inner: rows without ranges can be left out."""
    size = ranges.agg(F.sum(F.octet_length("ranges") + 120)).first()[0] or 0
    if size > broadcast_bytes:
        at = len(docs.columns)
        return docs.join(ranges, ["doc", "th"], "inner" if inner else "left"), lambda: lambda b: b.column(at).to_pylist()
    found = ranges.toArrow()
    keys = zip(found.column("doc").to_pylist(), found.column("th").to_pylist(), strict=True)
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(keys, found.column("ranges").to_pylist(), strict=True)))
    return docs, lambda: (lambda d: lambda b: [d.get(x) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])(known.value)


def unpacked(ranges: bytes | None) -> list[tuple[int, int]]:
    return [tuple(x) for x in np.frombuffer(ranges or b"", "<i4").reshape(-1, 2).tolist()]


def full_windows(docs: DataFrame, ranges: DataFrame, window: int, broadcast_bytes: int) -> DataFrame:
    """(h, doc, th, pos): the full windows that start in each row's ranges."""
    frame, lookup = with_ranges(docs, ranges, broadcast_bytes, inner=True)

    def factory():
        roll, find = Rolling(), lookup()

        def step(b: pa.RecordBatch):
            out = Collected()
            for doc, th, text, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2)), find(b), strict=True):
                if not packed:
                    continue
                words = text.split()
                starts = [np.arange(x, min(y, len(words) - window + 1)) for x, y in unpacked(packed)]
                at = np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int64)
                if len(at):
                    out.add(roll.windows(roll.prefix(words), at, window), doc, th, at)
            yield out.batch()

        return step

    return arrow_map(frame, WINDOWS, factory, rows=200)


NAMES = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]


def removed(docs: DataFrame, ranges: DataFrame, kind: str, broadcast_bytes: int, text: bool) -> DataFrame:
    frame, lookup = with_ranges(docs, ranges, broadcast_bytes, inner=False)
    width = 5 if text else 4

    def factory():
        find = lookup()

        def step(b: pa.RecordBatch):
            n, gone, kept = [], [], []
            for body, packed in zip(raw(b.column(2)), find(b), strict=True):
                words = body.split()
                n.append(len(words))
                if packed:
                    keep = np.ones(len(words), bool)
                    for x, y in unpacked(packed):
                        keep[x:y] = False
                    gone.append(int((~keep).sum()))
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                else:
                    gone.append(0)
                kept.append(b" ".join(words))
            columns = [b.column(3), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array([x.decode() for x in kept], pa.string()) if text else None]
            yield batch(NAMES[:width], columns[:width])

        return step

    return arrow_map(frame, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * text, factory)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the text left, if asked for) of every row of docs (doc_id, text)."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("doc"), F.xxhash64("text").alias("th"), "text", "doc_id")
    plain = own.select("doc", "th", "text")
    found = anchors(plain, window)
    repeated = materialize(shared(found), "anchors")
    # a window holds an anchor if the anchor starts at one of its first PERIOD words
    near = materialize(packed_ranges(found.join(repeated.select("h"), "h", "left_semi"), PERIOD - 1, 1), "near")
    full = materialize(full_windows(plain, near, window, broadcast_bytes), "windows")
    # written first, so that the join's sides are two exchanges, between which Spark splits a hot passage's rows
    least = materialize(shared(full), "least")
    gone = full.join(least, "h").where("doc > least")
    ranges = materialize(packed_ranges(gone, 0, window), "gone")
    return removed(own, ranges, kind, broadcast_bytes, text)
