"""Line dedup over a sharded minimal perfect hash.

The distinct keys of each document give 128-bit hashes, which are counted by document. The hashes found in `min_docs`
documents or more go into shards of bounded size; each shard is a minimal perfect hash (levels of bit arrays, a key's
slot is the rank of its bit) over arrays of a 64-bit fingerprint, a count and the largest doc_id. Documents
probe the arrays: the fingerprint tells foreign lines, so lines that are in few documents need no entry.

The shards' total size is measured. Up to `broadcast_bytes` they go to every worker and documents are probed in one
scan, without shuffling text. Beyond, line hashes are sent to the shards instead (cut in parts, so that a hot line
is not one task) and what they find comes back by doc_id.

Definitions: a null or empty text is one empty line; a null doc_id counts as one document below all others; rows that
share a doc_id are one document for counting and each keeps or loses its own lines. An empty table gives an empty
result, further columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, materialize, raw

LEAST_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS = 1 << 20
BROADCAST_BYTES = 64 << 20
#: Line hashes that one task probes where they are sent to the shards.
PART_ROWS = 1 << 20
LOWEST = -(1 << 63)
GAMMA, LEVELS = 2.0, 60


def key_of(line: bytes, least: int = LEAST_CHARS) -> bytes | None:
    """The line stripped and lowered, or None if that is shorter than `least` code points."""
    key = line.strip().lower()
    if len(key) < least or not key.isascii() and len(key.decode()) < least:
        return None
    return key


def hashes(keys: list[bytes]) -> np.ndarray:
    """(n, 2) unsigned: slot hash and fingerprint."""
    return np.frombuffer(b"".join([xxhash.xxh128_digest(k) for k in keys]), "<u8").reshape(-1, 2)


def mixed(h: np.ndarray, level: int) -> np.ndarray:
    """A level's own hash (the finalizer of splitmix64)."""
    x = h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit hashes: about three bits a key."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        rest, self.sizes = keys, []
        while len(rest):
            if len(self.levels) == LEVELS:
                raise ValueError("the keys are not distinct")
            size = max(64, int(GAMMA * len(rest)) // 64 * 64 + 64)
            at = (mixed(rest, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            self.sizes.append(size)
            rest = rest[~alone[at]]
        ones = np.bitwise_count(np.concatenate([*self.levels, np.zeros(0, "<u8")])).astype(np.int64)
        self.rank = np.concatenate(([0], np.cumsum(ones)))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for foreign keys any slot, or -1."""
        out, todo, first = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, (bits, size) in enumerate(zip(self.levels, self.sizes, strict=True)):
            at = (mixed(keys[todo], level) % np.uint64(size)).astype(np.int64)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[here]] = (self.rank[first + (at >> 6)] + below)[here]
            todo, first = todo[~here], first + len(bits)
        return out


class Shard:
    """fingerprint, count of documents and largest doc_id of each slot; only lines of enough documents have one."""

    def __init__(self, h: np.ndarray, fingerprint: np.ndarray, count: np.ndarray, largest: np.ndarray):
        self.hash = PerfectHash(h)
        at = self.hash.slots(h)
        self.fingerprint, self.count, self.largest = (np.empty(len(h), kind) for kind in (np.uint64, np.uint32, np.int64))
        self.fingerprint[at], self.count[at], self.largest[at] = fingerprint, np.minimum(count, 0xFFFFFFFF), largest
        self.more: dict[tuple[int, int], int] = {}

    def drops(self, h: np.ndarray, fingerprint: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which lines go: known ones, but for the largest doc_id."""
        at = self.hash.slots(h)
        slot = np.maximum(at, 0)
        gone = (at >= 0) & (self.fingerprint[slot] == fingerprint) & (self.largest[slot] != doc)
        if self.more:
            found = [self.more.get((a, b)) for a, b in zip(h.tolist(), fingerprint.tolist(), strict=True)]
            gone |= np.array([x is not None and x != d for x, d in zip(found, doc.tolist(), strict=True)], bool)
        return gone


def shard_of(h: Column, shards: int) -> Column:
    return F.pmod(F.shiftright(h, 20), F.lit(shards)).cast("int")


def line_hashes(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(h, fp, doc, th): the distinct keys of each row of docs (doc_id, text); th is a hash of the row's text."""

    def factory():
        def step(b: pa.RecordBatch):
            keys, doc, hashed = [], [], []
            ids = b.column(0).fill_null(LOWEST).to_numpy(zero_copy_only=False)
            for text, one, th in zip(raw(b.column(2)), ids, b.column(1).to_numpy(), strict=True):
                own = {k for line in text.split(b"\n") if (k := key_of(line, least)) is not None}
                keys += own
                doc.append(np.full(len(own), one, np.int64))
                hashed.append(np.full(len(own), th, np.int64))
            h = hashes(keys).view(np.int64)
            yield batch(["h", "fp", "doc", "th"], [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(np.concatenate(doc)), pa.array(np.concatenate(hashed))])

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("th"), "text"), "h bigint, fp bigint, doc bigint, th bigint", factory)


def build_index(lines: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """Shards (shard, body) of the hashes that min_docs documents have, and their number."""
    per_doc = lines.groupBy("h", "fp", "doc").agg(F.lit(1).alias("_"))
    counts = materialize(per_doc.groupBy("h", "fp").agg(F.count("*").alias("n"), F.max("doc").alias("largest")).where(F.col("n") >= min_docs), "counts")
    shards = max(1, -(-counts.count() // shard_keys))

    def build(t: pa.Table) -> pa.Table:
        c = {k: t.column(k).to_numpy() for k in ("h", "fp", "n", "largest")}
        # of two keys with one slot hash (a chance of 2^-64 a pair) the second is listed apart
        h, first = np.unique(c["h"], return_index=True)
        shard = Shard(h.view(np.uint64), c["fp"][first].view(np.uint64), c["n"][first], c["largest"][first])
        rest = np.setdiff1d(np.arange(t.num_rows), first)
        shard.more = {(int(a), int(b)): int(x) for a, b, x in zip(c["h"][rest].view(np.uint64), c["fp"][rest].view(np.uint64), c["largest"][rest], strict=True)}
        body = pickle.dumps(shard, protocol=5)
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "body": pa.array([body], pa.binary())})

    return materialize(counts.withColumn("shard", shard_of(F.col("h"), shards)).groupBy("shard").applyInArrow(build, "shard int, body binary"), "shards"), shards


NAMES = ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"]


def cut(texts: list[bytes], drop, least: int) -> tuple[list[int], list[int], list[bytes]]:
    """Lines, dropped lines and kept text of each; drop(row of each key, hashes) says which keys go."""
    every = [t.split(b"\n") for t in texts]
    at, keys = [], []
    for i, lines in enumerate(every):
        for j, line in enumerate(lines):
            if (k := key_of(line, least)) is not None:
                at.append((i, j))
                keys.append(k)
    gone: dict[int, set[int]] = {}
    if keys:
        for k in np.flatnonzero(drop(np.array([i for i, _ in at]), hashes(keys))):
            gone.setdefault(at[k][0], set()).add(at[k][1])
    kept = [t if i not in gone else b"\n".join([x for j, x in enumerate(lines) if j not in gone[i]]) for i, (t, lines) in enumerate(zip(texts, every, strict=True))]
    return [len(x) for x in every], [len(gone.get(i, ())) for i in range(len(texts))], kept


def result(ids: pa.Array, n: list[int], dropped: list[int], kept: list[bytes], text: bool) -> pa.RecordBatch:
    columns = [ids, pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
    if text:
        columns.append(pa.array([x.decode() for x in kept], pa.string()))
    return batch(NAMES[: len(columns)], columns)


def probe_broadcast(docs: DataFrame, index: DataFrame, shards: int, schema: str, least: int, text: bool) -> DataFrame:
    bodies = {r["shard"]: bytes(r["body"]) for r in index.collect()}  # the caller has checked their size
    shared = docs.sparkSession.sparkContext.broadcast(bodies)

    def factory():
        own = {k: pickle.loads(v) for k, v in shared.value.items()}

        def step(b: pa.RecordBatch):
            ids = b.column(0).cast(pa.int64()).fill_null(LOWEST).to_numpy(zero_copy_only=False)

            def drop(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
                out = np.zeros(len(h), bool)
                where = (h[:, 0].view(np.int64) >> 20) % shards
                for k, shard in own.items():
                    mine = np.flatnonzero(where == k)
                    out[mine] = shard.drops(h[mine, 0], h[mine, 1], ids[rows[mine]])
                return out

            yield result(b.column(0), *cut(raw(b.column(1)), drop, least), text)

        return step

    return arrow_map(docs, schema, factory)


def probe_routed(docs: DataFrame, lines: DataFrame, index: DataFrame, shards: int, schema: str, least: int, text: bool, part_rows: int) -> DataFrame:
    sizes = lines.groupBy(shard_of(F.col("h"), shards).alias("shard")).count()
    parts = materialize(index.select("shard").join(sizes, "shard").select("shard", F.ceil(F.col("count") / part_rows).cast("int").alias("parts")), "parts")
    routed = lines.withColumn("shard", shard_of(F.col("h"), shards)).join(F.broadcast(parts), "shard")  # a row for each shard of a million keys
    routed = routed.withColumn("part", F.pmod(F.xxhash64("doc", "th"), F.col("parts")).cast("int")).select("shard", "part", "h", "fp", "doc", "th")
    copies = index.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("shard", "part", "body")

    def probe(rows: pa.Table, body: pa.Table) -> pa.Table:
        if not (rows.num_rows and body.num_rows):
            return pa.table({k: pa.array([], pa.int64()) for k in ("doc", "th", "h")})
        c = [rows.column(k).to_numpy() for k in ("h", "fp", "doc", "th")]
        gone = pickle.loads(body.column("body")[0].as_py()).drops(c[0].view(np.uint64), c[1].view(np.uint64), c[2])
        return pa.table({"doc": pa.array(c[2][gone]), "th": pa.array(c[3][gone]), "h": pa.array(c[0][gone])})

    found = routed.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(probe, "doc bigint, th bigint, h bigint")
    per_row = found.groupBy("doc", "th").agg(F.collect_set("h").alias("gone"))
    own = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("doc"), F.xxhash64("text").alias("th"))
    joined = own.join(per_row, ["doc", "th"], "left").select("doc_id", "text", "gone")

    def factory():
        def step(b: pa.RecordBatch):
            gone = [set(x or ()) for x in b.column(2).to_pylist()]

            def drop(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
                return np.array([x in gone[i] for i, x in zip(rows.tolist(), h[:, 0].view(np.int64).tolist(), strict=True)])

            yield result(b.column(0), *cut(raw(b.column(1)), drop, least), text)

        return step

    return arrow_map(joined, schema, factory)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, least: int = LEAST_CHARS, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS, part_rows: int = PART_ROWS, text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (and kept, the text left, if asked for) of every row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string" + ", kept string" * text
    own = docs.select("doc_id", "text")
    lines = materialize(line_hashes(own, least), "lines")
    index, shards = build_index(lines, min_docs, shard_keys)
    size = index.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    if size <= broadcast_bytes:
        return probe_broadcast(own, index, shards, schema, least, text)
    return probe_routed(own, lines, index, shards, schema, least, text, part_rows)
